import pytest
from pyspark.sql import functions as F

from stratakeep.llm import htmltext as H


@pytest.fixture(scope="module")
def field():
    return H.default_field()


def test_accuracy_on_held_out_layouts(field):
    wrong = total = 0
    for rows, labels in H.labelled_pages(150, seed=99):
        got = field.decode(rows)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.03


def test_viterbi_is_the_best_labelling(field):
    import itertools

    for rows, _ in H.labelled_pages(12, seed=5):
        rows = rows[:9]
        s, t = field.scores(rows), field.transitions
        value = lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
        best = max(value(y) for y in itertools.product((0, 1), repeat=len(rows)))
        assert value(field.decode(rows)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies here.</p><button>Accept</button></div>
<article><h1>A &amp; B&nbsp;title</h1><p><b>First   line of the story, and more.<br>after</p><p>Second &#233;t&eacute; paragraph with
a line break in it.<table><tr><td>Cell one of the table</td><td>cell two</td></tr></table><ul><li>An item of the list.</li></ul></article>
<section id="comments"><h3>Comments</h3><ol><li><p>Nice one, thank you for it.</p></li></ol></section>
<aside><p>Related stories that you may like.</p></aside><form><label>Your mail</label><input></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_of_a_page(field):
    got = H.main_text(PAGE, field).split("\n")
    assert got == ["A & B title", "First line of the story, and more. after", "Second été paragraph with a line break in it.", "Cell one of the table", "cell two", "An item of the list."]


@pytest.mark.parametrize("page", ["", None, "<", "<a", "</p></div>", "<!-- no end", "<script>x", "&#xFFFFFFF; &bogus;", "<p " + "x" * 5000, "<div>" * 3000, "\x00<p>\x00"])
def test_broken_pages_do_not_fail(field, page):
    assert isinstance(H.main_text(page, field), str)


def test_frame_keeps_rows_and_clashing_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, "z"), (2, "v", "", "w")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, t string")
    got = H.extract(frame).orderBy("t").collect()
    assert [r.t for r in got] == ["w", "x", "y", "z"] and got[1].text == got[2].text != ""
    assert got[0].text == got[3].text == ""
    assert H.extract(frame.limit(0)).count() == 0
    chars = H.extract(frame).select(F.char_length("text").alias("n")).collect()
    assert max(r.n for r in chars) == len(H.main_text(PAGE, H.default_field()))


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p class="a"">First sentence. He said "no" twice.</p><p>Second.</p>', ['First sentence. He said "no" twice.', "Second."]),
        ("<p class=it's>First.</p><p>It's third.</p>", ["First.", "It's third."]),
        ("<p \"x' y>First.</p><p>Second.</p></p '><p>Third.</p>", ["First.", "Second.", "Third."]),
        ("<p title = '>' data=\"a>b\" class=>First.</p><p =\">Second.</p>", ["First.", "Second."]),
        ("<!--><p>First.</p><!-- no --!><p>Second.</p><![CDATA[x><p>Third.</p>", ["First.", "Second.", "Third."]),
    ],
)
def test_tags_end_where_html_ends_them(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


@pytest.mark.parametrize("name", ["svg", "noscript", "template", "iframe", "select", "annotation", "annotation-xml"])
def test_an_unclosed_element_does_not_cut_the_page(name):
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts(f"<p>A</p><{name} x='y'><p>B</p><p>C</p>") == ["A", "B", "C"]
    assert texts(f"<p>A</p><{name}><p>B</p><{name}>no</{name.upper()} ><p>C</p>") == ["A", "B", "C"]
    assert texts(f"<{name}>no<{name}>no</{name}>no</{name}><p>A</p><{name}/><p>B</p>") == ["A", "B"]
    assert texts(f"<{name}>no<!-- <{name}> --><script>'<{name}>'</script></{name}><p>A</p>") == ["A"]


def test_formulas_and_fallbacks_stay_in_their_blocks():
    formula = "<math display='block'><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow><annotation encoding='tex'>x^2</annotation></semantics></math>"
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts(f"<p>As {formula} holds.</p><p>B</p>") == ["As x2=4 holds.", "B"]
    assert texts("<p>A film: <object data='f'><param name='x'>a cat sleeps</object> for long.</p>") == ["A film: a cat sleeps for long."]
    assert texts("<math><mi>x<p>A</p>") == ["x", "A"] and texts("<p>A<object><p>B</p><p>C</p>") == ["A", "B", "C"]


def test_only_whole_attribute_names_give_words():
    (block,) = H.blocks("<div data-id=nav alt='class=menu' CLASS=Story id='a-1'>Text</div>")
    assert block.words == ("class", "story", "id", "a")


@pytest.mark.parametrize("name", ["script", "STYLE", "title", "Textarea", "svg"])
def test_letters_that_lower_to_two_do_not_shift_the_end(name):
    page = f"<p>{'İ' * 40}</p><{name}>no</{name.swapcase()}\n><p>Real text.</p><p>Second</p>"
    assert [b.text for b in H.blocks(page)] == ["İ" * 40, "Real text.", "Second"]
    assert [b.text for b in H.blocks(f"{'İ' * 99}<{name}>no</{name}>end")] == ["İ" * 99, "end"]


def test_only_the_whole_name_ends_a_script():
    assert [b.text for b in H.blocks("<script>a</scripty>b</ſcript>c</SCRIPT>d")] == ["d"]


SAID = "The committee met on Tuesday to discuss the harbour works, which have taken longer than anyone expected."
ALSO = "Residents said that they were tired of the noise, and asked for a date by which it ends."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="x1a"><a href="/">Home</a> <a href="/n">News</a></div><div class="q9z"><div class="k2"><h1>Harbour works</h1><p>{SAID}</p><p>{ALSO}</p></div></div><div class="z7">Copyright 2020 us</div>', f"Harbour works\n{SAID}\n{ALSO}"),
        (f'<div class="css-1ab"><div class="css-9x"><span class="css-3">{SAID}</span></div><div class="css-9x"><span class="css-3">{ALSO}</span></div></div>', f"{SAID}\n{ALSO}"),
        (f"<article><header><h1>Harbour works</h1></header><p>{SAID}</p><p>All rights reserved.</p></article><footer>&copy; us</footer>", f"Harbour works\n{SAID}\nAll rights reserved."),
        (f'<article><p aria-hidden="false">{SAID}</p><p hidden>{ALSO}</p><div aria-hidden="true">{ALSO}</div><p style="display: none">{ALSO}</p><p style="color:red">{ALSO}</p></article>', f"{SAID}\n{ALSO}"),
        (f'<table><tr><td><a href="/">Home</a></td><td><h1>Harbour works</h1><p>{SAID}</p><p>{ALSO}</p></td></tr><tr><td>Copyright us 2020</td></tr></table>', f"Harbour works\n{SAID}\n{ALSO}"),
        (f'<main><h1>Harbour works</h1><p>{SAID}</p></main><section id="responses"><p>Great read!</p></section>', f"Harbour works\n{SAID}"),
    ],
)
def test_layouts_beside_the_usual_ones(page, text):
    assert H.main_text(f"<html><body>{page}</body></html>", H.default_field()) == text
