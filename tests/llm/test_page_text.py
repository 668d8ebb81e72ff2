"""Main text of pages with and without a template."""

from sitewise.llm.pages import Template, extract, main_text, templates

HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def page(body, foot="</body></html>"):
    return HEAD + body + foot


def test_article_alone():
    assert main_text(page("<nav><a>menu</a></nav><article><h1>Title &amp; more</h1><p>One  <b>bo</b>ld<br>line<p>Two &eacute;</article><footer>&copy;</footer>"), None) == (
        "Title & more\n\nOne bold line\n\nTwo é"
    )


def test_what_is_not_the_article():
    inside = (
        "<header><h1>Own heading</h1></header><p>Text</p><div class='ad-box'>Buy</div><aside>Side</aside><form><p>Name</p></form><p hidden>x</p>"
        "<div id=comments><p>First!</p></div><div class='cookie-notice'>Accept</div><!-- note --><p>End"
    )
    assert main_text(page(f"<header>Site</header><main>{inside}"), None) == "Own heading\n\nText\n\nEnd"


def test_broken_pages():
    assert main_text("", None) == "" and main_text("<", None) == "<" and main_text("plain", None) == "plain"
    assert main_text(page("<article><p>cut off &lt;here", ""), None) == "cut off <here"
    assert main_text(page("<article><p>a < b <unclosed", ""), None).startswith("a < b")
    assert main_text(page("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>"), None) == "one\n\ntwo\n\nx\n\ny"
    assert main_text("<article>" + "<div>" * 3000 + "deep", None) == "deep"


def site(n):
    """Pages without any telling element: the template must part text from the rest."""
    rows = []
    for i in range(n):
        story = "".join(f"<p>Sentence {k} of story {i} tells something of its own.</p>" for k in range(3 + i % 4))
        rows.append((i, f"https://plain.example.com/{i}", f"<html><body><div><div>Home</div><div>About us</div></div><div><h2>Story {i}</h2>{story}</div><div>All rights</div></body></html>"))
    return rows


SCHEMA = "page_id bigint, url string, html string"


def test_template_parts_constant_from_varying_text(spark):
    rows = site(12)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, _, _ in rows:
        assert got[i] == "\n\n".join([f"Story {i}", *(f"Sentence {k} of story {i} tells something of its own." for k in range(3 + i % 4))])


def test_equivalence_classes(spark):
    keyed = spark.createDataFrame([("h", i, html) for i, _, html in site(8)] + [("alone", 99, "<p>x")], "host string, page bigint, html string")
    found = {r.host: r for r in templates(keyed).collect()}
    assert set(found) == {"h"} and found["h"].pages == 8
    paths = {t.path for t in found["h"].template if t.path}
    assert {">html", ">html>body", ">html>body>div>h2"} <= paths and ">html>body>div>p" not in paths


def test_template_inside_the_article_goes(spark):
    line = "<div>Get our letter every week</div>"
    rows = [(i, f"https://news.example.com/{i}", page(f"<nav>Menu</nav><article><h1>Story {i}</h1>{line}<p>What happened in {i}.</p><p>Read also</p></article>")) for i in range(8)]
    rows.append((99, "https://single.example.com/", page(f"<article>{line}<p>Alone</article>")))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i}\n\nWhat happened in {i}." for i in range(8)} | {99: "Get our letter every week\n\nAlone"}


def test_classes_that_cross_are_not_both_valid():
    rows = [{"token": t, "class": c, "size": {7: 2, 8: 3, 9: 2}[c], "few": False} for t, c in zip((1, 2, 3, 4, 5, 6, 7), (8, 9, 8, 9, 8, 7, 7), strict=True)]
    assert Template(rows).valid([1, 2, 3, 4, 5, 6, 7]) == {1, 3, 5, 6, 7}  # 9 has members in two slots of 8
    assert Template(rows).valid([1, 2, 4, 3, 5, 7, 6]) == {1, 2, 3, 4, 5}  # here in one; 7 is out of order


def test_names_and_forms_around_the_article():
    text = "<p>Text of the story.</p><p>More of it.</p>"
    story, rest = f"<article><header><h1>Title</h1></header>{text}<div class=ad-box>Buy</div></article>", "<div id=comments><article class=comment><p>First of all!</article></div><div class=site-footer>Foot</div>"
    want = "Title\n\nText of the story.\n\nMore of it."
    for around in ("div class='layout has-sidebar'", "div class='no-sidebar'", "div class='header-fixed'", "div class='page-with-comments'", "form id=aspnet", "div class=widget"):
        assert main_text(page(f"<{around}><nav>Menu</nav>{story}{rest}</{around.split()[0]}>"), None) == want, around
    assert main_text(page(story.replace("<article>", "<article class='post widget'>") + rest), None) == want
    assert main_text(page(f"<form><div class=menu>Menu</div><div>{text}</div></form>"), None).endswith("Text of the story.\n\nMore of it.")
    # what is boilerplate stays out
    assert main_text(page(f"<div>{text}</div>{rest}"), None) == "Text of the story.\n\nMore of it."
    assert main_text(page("<div class=cookie-notice>Accept</div><form><p>Name</p></form>"), None) == ""
    assert main_text(page("<nav><article><p>Menu</p></article></nav>"), None) == ""


def test_layouts_of_a_part_of_the_pages(spark):
    rows, texts = [], {}
    for i in range(15):
        kind = "abc"[i % 3]
        story = [f"Story {i}", *(f"Sentence {k} of story {i}." for k in range(2 + i % 4))]
        body = "".join(f"<p>{t}</p>" for t in story)
        rows.append((i, f"https://mixed.example.com/{i}", f"<html><body><div class=top-{kind}><div>Home {kind}</div></div><div class=text-{kind}>{body}</div><div>Rights {kind}</div></body></html>"))
        texts[i] = "\n\n".join(story)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == texts


def test_copied_article_is_no_template(spark):
    rows = [(i, f"https://copies.example.com/{i}", page(f"<nav>Menu</nav><article><h1>Story {i}</h1><p>What happened in {i}.</p></article>")) for i in range(20)]
    rows += [(i, f"https://copies.example.com/{i}", page(f"<nav>Menu</nav><article><h1>Press</h1><p>Said {i}.</p><ul><li>One</ul><p>Two</article>")) for i in range(20, 24)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in (0, 20, 23)] == ["Story 0\n\nWhat happened in 0.", *(f"Press\n\nSaid {i}.\n\nOne\n\nTwo" for i in (20, 23))]


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, None), (1, "x", ""), (None, "https://a.example/b", page("<article><p>t")), (2, "https://a.example/b", page("<article><p>t")), (2, "https://a.example/b", page("<article><p>t"))]
    table = spark.createDataFrame([(*r, "h", 1, "t", 2) for r in rows], SCHEMA + ", host string, pages int, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(table).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, "x", "", 0), (None, rows[2][1], "t", 1), (2, rows[2][1], "t", 1), (2, rows[2][1], "t", 1)], key=str)
    assert extract(table.limit(0)).collect() == []


def framed(i, title, first):
    story = "".join(f"<p>Sentence {k} of story {i} tells something of its own.</p>" for k in range(3 + i % 4))
    return f"<html><body><div>Home</div><article><h1>{title}</h1><p>{first}</p>{story}<p>Sign up for our letter today.</p></article><div>All rights</div></body></html>"


def test_shared_title_and_lead_stay(spark):
    rows = [(i, f"https://a.example.com/{i}", framed(i, "Daily report", "What happened today, in short.")) for i in range(30)]
    rows += [(100 + i, f"https://b.example.com/{i}", framed(i, f"Report {i}", "Support us with a gift.")) for i in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(30):
        story = [f"Sentence {k} of story {i} tells something of its own." for k in range(3 + i % 4)]
        assert got[i] == "\n\n".join(["Daily report", "What happened today, in short.", *story])
        assert got[100 + i] == "\n\n".join([f"Report {i}", *story])


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    used = []
    for depth in (5_000, 40_000):
        for tag in ("<div>", "<div class=ad>"):
            source = page(tag * depth + "<p>deep one</p><p>deep two</p>", "")
            tracemalloc.start()
            assert main_text(source, None) == "deep one\n\ndeep two"
            used.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert used[2] < 12 * used[0] and used[3] < 12 * used[1] and max(used) < 100e6
