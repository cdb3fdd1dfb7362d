"""Unseen elements end where HTML ends them, also where their end tags are left out."""

import pytest
from quillon.llm import html_text

AFTER = "<p>The text after it.</p>"


def blocks(html):
    return [t for t in html_text.parse(html).texts if t]


@pytest.mark.parametrize(
    "unseen",
    [
        "<select><option>A<option>B</select>",
        "<select><optgroup label=x><option>A<option>B<optgroup label=y><option>C</select>",
        "<select><option>A</option><option>B</option></select>",
        "<input list=d><datalist id=d><option value=a><option value=b></datalist>",
        "<select><option>A<select>",
        "<head><title>T</title><meta charset=utf-8><style>p {}</style>",
        "<head><title>T</title><script>if (a < b) { x = '<p>no</p>' }</script><noscript><img src=x></noscript>",
        "<head><title>T</title></head><body>",
        "<head><title>T</title><body>",
        "<div><option>A<option>B</div>",
        "<button>A<button>B</button>",
        "<template><template>A</template>B</template>",
        "<svg><title>A</title><g><text>B</text></g></svg>",
        "<video><source src=a></video><iframe src=a></iframe><svg/>",
        "<object>A<button>B</object>",
    ],
)
def test_text_after_unseen_elements_stays(unseen):
    assert blocks(unseen + AFTER) == ["The text after it."]
    assert blocks("<div>" + unseen + "</div>" + AFTER)[-1] == "The text after it."


@pytest.mark.parametrize(
    "before",
    [
        "<nav><button>Menu</nav>",
        "<div><button>Menu</div>",
        "<div><canvas></div>",
        "<div><svg><path></div>",
        "<div><video src=x></div>",
        "<ul><li><button>A<li><button>B</ul>",
        "<table><tr><td><button>B</table>",
        "<div><button><div>Menu</div></div>",
        "<div><object><p>A</div>",
        "<section><select><option>A</section>",
        "<div><svg><g><path d=1></g></div>",
        "<div><audio><source src=a></div>",
        "<div><noscript><img src=a></div>",
        "<div><datalist><option>A</div>",
        "<div><svg><foreignObject><div>A</div></foreignObject></svg></div>",
        "<header><nav><ul><li><button>B<ul><li>C</ul></nav></header>",
    ],
)
def test_unseen_elements_end_with_what_they_stand_in(before):
    for after in (AFTER, "<article>" + AFTER + "</article>"):
        assert blocks(before + after) == ["The text after it."]
        assert blocks("<main>" + before.upper() + after + "</main>") == ["The text after it."]


@pytest.mark.parametrize("open_one", ["<button>Menu", "<svg><path>", "<canvas>", "<select><option>A", "<div><button><div>A</div>", "<video>", "<object>A"])
def test_an_article_ends_an_open_widget(open_one):
    assert blocks(open_one + "<article>" + AFTER + "</article>") == ["The text after it."]


@pytest.mark.parametrize("html", ["<table><tr><td><button>B<td>Text</table>", "<p><video src=x><p>Text", "<svg><path><p>Text", "<svg><g><table><tr><td>Text</table>", "<div><svg><desc><p>no</p></desc></svg>Text</div>"])
def test_starts_of_elements_end_unseen_ones(html):
    assert blocks(html) == ["Text"]


@pytest.mark.parametrize("html", ["<div><iframe></div>no", "<div><textarea></div>no", "<div><script></div>no", "<div><style></div>no", "<div><template><p>no</div>no"])
def test_raw_text_goes_on_to_its_own_end_tag(html):
    assert blocks(html) == []
    assert blocks("<div><button>a<div>b</div>c</button>Text</div>") == ["Text"]


def test_text_ends_an_open_head():
    assert blocks("<head><title>T</title>\n Plain words.<p>More.") == ["Plain words.", "More."]


def test_formulas_are_part_of_their_paragraph():
    html = "<p>So <math><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> holds.</p>"
    assert blocks(html) == ["So E=mc2 holds."]
    html = "<p>So <math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\vec x</annotation></semantics></math> holds.</p>"
    assert blocks(html) == ["So x holds."]


def test_an_article_after_a_list_and_an_open_head_is_whole(spark, sf_dir):
    text = ["Storm", "It rained all night and the river rose over its banks.", "Nobody was hurt, officials said on Monday morning."]
    html = "<head><title>T</title><meta charset=utf-8><article><h1>%s</h1><p>%s<p>%s</article><form><select><option>A<option>B</select></form>" % tuple(text)
    model = html_text.train(html_text_pages(spark, sf_dir))
    assert html_text.main_texts(model, [html]) == ["\n\n".join(text)]


def html_text_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
