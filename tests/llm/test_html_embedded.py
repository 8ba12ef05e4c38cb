import pytest

from siftstone.llm import html


def words(source: str) -> str:
    return "|".join(t for _, t in html.parse(source).blocks)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><p>one <svg class=i/> two</p><p>three</p></article>", "one two|three"),
        ("<article><p>one</p><svg viewBox='0 0 1 1'><p>two</p></article><p>three <svg><text>no</text></svg> four", "one|two|three four"),
        ("<article><p>one</p><video src=x><p>two</p></article><p>three", "one|two|three"),
        ("<article><video src=x><p>no</p></article><p>one <video>no <b>no</b></video> two", "one two"),
        ("<p>one <canvas>no<p>no</p></canvas> two", "one two"),
        ("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>no</annotation></math> holds</p><p>end", "so E=m holds|end"),
        ("<p>pick <select><option>no<option>no</select> one</p><object data=x></object><p>end", "pick one|end"),
        ("<div>a<audio controls>b</div><div>c</div><audio></audio>d", "a|c|d"),
        ("<p>a<script>'</p><svg>'</script> b<svg><title>no</title><path d=x /></svg></p>", "a b"),
        ("<p>a<math><mi>b</p><p>c", "ab|c"),
    ],
)
def test_embedded_elements_hide_only_their_own_text(source, want):
    assert words(source) == want


def test_text_before_an_unclosed_element_stays_in_its_block():
    page = html.parse("<div>a<audio controls>b</div><p>c</p><audio></audio>d")
    assert [(page.nodes[n].tag, t) for n, t in page.blocks] == [("div", "a"), ("p", "c"), ("#page", "d")]
