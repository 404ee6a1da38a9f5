"""Text that browsers show though it has no place in a table, or stands in form fields and drawings."""

import pytest

from millrace.llm.html_text import page_text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table>note<tr><td>x</td></tr></table>", "note\n\nx"),
        ("<table><tr><p>a</p><td>b</td></tr></table>", "a\n\nb"),
        ("<table><tbody><div>a</div><tr><td>b<td>c</table>d", "a\n\nb  c\n\nd"),
        ("<table><tr><td>b</td>late</tr></table>", "late\n\nb"),
        ("<table><div>a<tr><td>b</table>", "a\n\nb"),
        ("<table><colgroup>n<tr><td>b</table>", "n\n\nb"),
        ("<table><tr><td><table>in<tr><td>y</table></table>", "in\n\ny"),
        ("<table><form><tr><td>b</td></tr></form></table>", "b"),
        ("<table><caption>c<td>x</table>", "c\nx"),
        ("<table><tr><td>a<tbody><tr><td>b</table>", "a\nb"),
        ("<table><thead><caption>c</caption><tr><td>a</table>", "c\na"),
        ("<form><table><tr><td>b</td></tr></table></form>", "b"),
        ("<table> <caption>C</caption> <tr> <td>x</td> </tr> </table>", "C\nx"),
        ("x<table><tr><td>a<table><tr><td>b</table>c", "x\n\na\n\nb\n\nc"),
        ("<p>a<textarea>\nb &amp;\n c</textarea>d", "a\nb &\n c\nd"),
        ("<textarea></textarea>x", "x"),
        ("<select><option>One<option selected>Two</select>", "One\nTwo"),
        ("a<svg><title>t</title><desc>no</desc><defs><text>no</text></defs><g/><text>up</text><text>to</text></svg>b", "a\nup\nto\nb"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> y", "x=1 y"),
        ("<desc>shown</desc> here", "shown here"),
    ],
)
def test_shown(page, text):
    assert page_text(page) == text
