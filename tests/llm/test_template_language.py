"""The template language: white space, tests, inline if, loops, slices, errors; and marks of custom templates."""

import pytest

from millrace.llm import chat
from millrace.llm.template import TemplateError, compile_template

M = [{"role": "system", "content": "be kind"}, {"role": "user", "content": " hi "}, {"role": "assistant", "content": "yo"}]


@pytest.mark.parametrize(
    "template,text",
    [
        ("a {%- if true -%} b {%- endif %} c", "ab c"),
        ("a {#- gone %} -#} b{# x #}", "ab"),
        ("{{- ' x ' -}}  y", " x y"),
        ("{% for m in ms %}{{ loop.index }}{{ loop.revindex }}/{{ loop.length }} {% endfor %}", "13/3 22/3 31/3 "),
        ("{% for a, b in [['x', 1], ['y', 2]] %}{{ a }}{{ b }}{% endfor %}", "x1y2"),
        ("{% for x in [] %}{% else %}none{% endfor %}", "none"),
        ("{{ 'a' if ms[-1].role == 'assistant' else 'b' }}{{ 'q' if false }}", "a"),
        ("{{ nope is defined }}{{ ms is defined }}{{ ms[0].tool is not defined }}{{ none is none }}{{ 'x' is string }}{{ 3 is not number }}", "FalseTrueTrueTrueTrueFalse"),
        ("{% for m in ms[1:] %}{{ m.role[0] }}{% endfor %}{{ 'abc'[::-1] }}{{ ms[9] }}", "uacba"),
        ("{{ 'x' not in 'abc' }}{{ not 'a' in 'abc' }}", "TrueFalse"),
        ("{{ 7 // 2 + 7 % 2 * 3 - -1 }}", "7"),
        ("{{ ['a', 'b'] | join(', ') | upper }}{{ nope | default('z') }}{{ '%}' ~ '}}' }}", "A, Bz%}}}"),
        ("{% for k, v in ms[0] | items %}{{ k }}={{ v }};{% endfor %}", "role=system;content=be kind;"),
        ("{% for m in ms %}{% if (m['role'] == 'user') != (loop.index0 % 2 == 1) %}{{ raise_exception('order') }}{% endif %}{{ m['content'] | trim }}{% endfor %}", "be kindhiyo"),
    ],
)
def test_language(template, text):
    assert compile_template(template)(ms=M)[0] == text


@pytest.mark.parametrize("template", ["{{ 1 < 'a' }}", "{{ x | length }}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{% if x %}" * 500, "{{ raise_exception('no') }}", "{{ 1 // 0 }}", "{{ x[0:1:0] }}", "{{ open('f') }}", "{{ " + "1+" * 3000 + "1 }}", "{{ " + "not " * 5 + "}}", "{{ [1][ }}", "{% for a, b in [1] %}{% endfor %}", "{{ 'a' - 1 }}", "{{ 'x' | join(1, 2, 3) }}"])
def test_errors_are_template_errors(template):
    with pytest.raises(TemplateError):
        compile_template(template)(x=3)


def test_marks_of_a_custom_template_are_escaped(spark):
    template = "{% for m in messages %}### {{ m.role | escape }}:\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<END>{% endfor %}"
    undo = chat.Escape.of(template)
    assert {"###", "<END>"} <= set(undo.marks)
    turns = spark.createDataFrame([(1, 0, "user", "say <END> and ###\\"), (1, 1, "assistant", "<END>### \\0; [INST]")], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_chats(turns, template).collect()
    assert r.formatted.count("<END>") == 2 and r.formatted.count("###") == 2
    assert [undo.undo(r.formatted[s.start : s.end]) for s in r.loss] == ["<END>### \\0; [INST]"]
