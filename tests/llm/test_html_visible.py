"""Text that a browser shows inside formulas, graphics and forms."""

from chronospark.llm import html


def test_visible_subtrees():
    page = """<p>f <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math></p><svg><title>no</title><style>a{}</style><desc>no</desc>stray
<g><text>Label</text><text>two</text></g></svg><p><select><option>red<option>blue<optgroup label=more><option>green</select></p>
<textarea>
a &lt; b
  c</textarea><p><object data=x>fallback</object><template>no</template><script>no</script><datalist><option>no</datalist>"""
    assert html.render(page)[1] == "f x=2\n\nLabel two\n\nred\nblue\nmore\ngreen\n\na < b\n  c\n\nfallback"
