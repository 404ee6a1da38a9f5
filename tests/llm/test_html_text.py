from millrace.llm.html_text import page_text


def test_blocks_lists_and_hidden():
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><ul><li><a href='/a'>One</a><li>Two</ul></nav><!-- ad --><h1>Head</h1><p>First <b>bold</b>\n text<br>line<p hidden>no</p><p style='display: none'>no</p><div>a</div>b<noscript>no</noscript></body></html>"
    assert page_text(page) == "- One\n- Two\n\nHead\n\nFirst bold text\nline\n\na\nb"


def test_ordered_and_nested_lists():
    assert page_text("<ol start=3><li>x<li>y<ul><li>z</ul><li>w</ol>") == "3. x\n4. y\n   - z\n5. w"


def test_tables_align():
    page = "<table><caption>C</caption><tr><th>Name<th>N<tr><td>ab<td>10<tr><td colspan=2>wide cell here</table>"
    assert page_text(page) == "C\nName        N\nab          10\nwide cell here"


def test_pre_entities_and_unclosed():
    assert page_text("<pre>\n a  b\n  c</pre><p>x &amp; y &lt;z&gt; <i>open") == " a  b\n  c\n\nx & y <z> open"


def test_odd_input():
    assert page_text(None) == page_text("") == ""
    assert page_text("a < b <") == "a < b <"
    assert page_text("<div>" * 5000 + "deep") == "deep"
    assert page_text("<script>never ends") == ""
