import pytest

from skarn.normalize import html, markdown, model, pagexml, render
from skarn.normalize.columns import normalize


def same(*trees):
    assert len({model.digest(t) for t in trees}) == 1, trees


def page(inner):
    return f'<one:Page xmlns:one="x"><one:Title><one:OE><one:T>t</one:T></one:OE></one:Title><one:Outline><one:OEChildren>{inner}</one:OEChildren></one:Outline></one:Page>'


def test_paragraph_with_link_is_the_same_in_all_formats():
    a = html.parse('<p>see <a href="https://x.y">the  page</a> now</p>')
    b = markdown.parse("see [the page](https://x.y) now")
    c, warnings = pagexml.parse(page('<one:OE><one:T><![CDATA[see <a href="https://x.y">the page</a> now]]></one:T></one:OE>'))
    same(a, b, c)
    assert not warnings and model.links(a) == ["https://x.y"]
    assert a["children"][0]["link_spans"] == [{"start": 4, "end": 12, "href": "https://x.y"}]


def test_lists_tasks_tables_code():
    same(html.parse("<ul><li>a</li><li>b</li></ul>"), markdown.parse("- a\n- b"), pagexml.parse(page("".join(f"<one:OE><one:List><one:Bullet/></one:List><one:T>{x}</one:T></one:OE>" for x in "ab")))[0])
    same(html.parse('<ul><li><input type="checkbox" checked>a</li></ul>'), markdown.parse("- [x] a"), pagexml.parse(page('<one:OE><one:Tag completed="true"/><one:T>a</one:T></one:OE>'))[0])
    same(html.parse("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"), markdown.parse("| a | b |\n|---|---|\n| 1 | 2 |"))
    same(html.parse('<pre><code class="language-py">x  = 1</code></pre>'), markdown.parse("```py\nx  = 1\n```"))
    same(html.parse("<h2>T <b>b</b></h2><p>x</p>"), markdown.parse("## T **b**\n\nx"), markdown.parse("T *b*\n---\nx"))


def test_list_kind_changes_and_nesting():
    tree = markdown.parse("1. a\n   - b\n   - c\n2. d\n\ntext")
    outer = tree["children"][0]
    assert outer["ordered"] and len(outer["items"]) == 2 and outer["items"][0]["children"][1]["items"][1]["children"][0]["text"] == "c"
    assert tree["children"][1]["text"] == "text"
    mixed = pagexml.parse(page("<one:OE><one:List><one:Bullet/></one:List><one:T>a</one:T></one:OE><one:OE><one:List><one:Number/></one:List><one:T>b</one:T></one:OE>"))[0]
    assert [c["ordered"] for c in mixed["children"]] == [False, True]


def test_breaks_quotes_rules_and_html_in_markdown():
    assert model.visible_text(markdown.parse("a  \nb\nc")) == "a\nb c"
    assert model.visible_text(markdown.parse("> q1\n> q2\n\n***\n\nz")) == "q1 q2\nz"
    same(markdown.parse("<div><p>x</p></div>"), html.parse("<p>x</p>"))
    assert model.visible_text(markdown.parse(r"\*a\* _b_ snake_case ~~c~~ `d*`")) == "*a* b snake_case c d*"


def test_media_placeholders_unsupported():
    resources = {"a" * 32: "h1", "image:1": "h2"}
    tree = html.parse(f'<p>x<img src=":/{"a" * 32}" alt="i"></p><a href=":/{"b" * 32}">f.pdf</a>', resources)
    assert model.count_kind(tree, "image") == 1 and model.count_kind(tree, "attachment") == 1
    assert [n["hash"] for n in model.walk(tree) if n["kind"] in ("image", "attachment")] == ["h1", None]
    tree, warnings = pagexml.parse(page("<one:OE><one:Image/><one:InkDrawing/><one:Odd/></one:OE>"), resources)
    assert [c["kind"] for c in tree["children"]] == ["image", "placeholder", "unsupported"] and len(warnings) == 1
    assert pagexml.parse("<broken")[0]["children"] == [] and pagexml.parse("<broken")[1]


def test_inline_blocks_are_flattened_and_skipped_elements_vanish():
    assert model.visible_text(html.parse("<span>a<p>b</p></span>c")) == "abc"
    assert model.visible_text(html.parse("<head><title>t</title></head><body><script>s</script>x<!-- c --></body>")) == "x"
    assert model.visible_text(html.parse("<p>a<p>b</div>c")) == "a\nbc"
    nested = html.parse("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>")
    assert len(nested["children"][0]["rows"]) == 1


def test_spaces_at_link_edges_belong_to_no_link():
    text, spans = model.text_with_spans([("a ", ""), (" b ", "u"), (" c", "")])
    assert text == "a b c" and spans == [{"start": 2, "end": 3, "href": "u"}]


@pytest.mark.parametrize("source", ["<h1>A</h1><p>b <a href='https://c'>d</a></p>", "<ol><li>x<ul><li>y</li></ul></li></ol>", "<table><tr><td><p>a</p><p>b</p></td><td></td></tr></table><pre>c &lt; d</pre>"])
def test_rendering_round_trip(source):
    tree = html.parse(source)
    same(tree, html.parse(render.render(tree)))


@pytest.mark.parametrize("opening", ["<p>", "<div>", "<ul><li>x", "<b>", "<table><tr><td>y"])
def test_deep_nesting_is_read_and_rendered(opening):
    tree, warnings = normalize("html", opening * 12_000 + "z")
    assert model.visible_text(tree).endswith("z") and not warnings and model.digest(tree)
    assert "z" in render.render(tree)


def test_deep_page_xml_and_canonical_json():
    import json

    from skarn.functions.hashing import canonical_json

    inner = "<one:OE><one:List><one:Bullet/></one:List><one:T>a</one:T><one:OEChildren>"
    deep = page(inner * 5000 + "</one:OEChildren></one:OE>" * 5000)
    tree, warnings = pagexml.parse(deep)
    assert model.visible_text(tree).count("a") == 5000 and not warnings and model.digest(tree)
    value = {"b": [1, {"ü": None, "a": "x\n"}, [], {}], "a": [True, 1.5]}
    plain = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert canonical_json(value) == plain
    nested = value
    for _ in range(50_000):
        nested = [nested, 2]
    assert canonical_json(nested) == "[" * 50_000 + plain + ",2]" * 50_000


def test_a_body_that_cannot_be_read_is_a_warning_of_its_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skarn.normalize import columns

    rows = spark.createDataFrame([(1, "html", "<ul><li>" * 3000 + "deep"), (2, "html", "<p>plain"), (3, "onenote-xml", "<broken"), (4, "html", None)], "id int, kind string, body string")
    found = {r["id"]: r for r in columns.with_normalized(rows, F.col("kind"), F.col("body")).collect()}
    assert found[1]["text"] == "deep" and found[2]["text"] == "plain" and found[3]["warnings"] and found[4]["text"] == ""
    told = columns.with_normalized(rows, F.col("kind"), F.col("body")).select("id", columns.block_digests(F.col("semantic_json")).alias("b"), columns.rendered(F.col("semantic_json")).alias("r"))
    assert {r["id"]: r["b"] is None for r in told.collect()} == {1: True, 2: False, 3: False, 4: False}
    monkeypatch.setattr(columns.html, "parse", lambda *_: (_ for _ in ()).throw(RecursionError()))
    row = columns.normalized_row("html", "x")
    assert row[1] == "" and row[-1] == ["body cannot be normalized: RecursionError"]


def test_page_lines_and_lists_as_the_source_has_them():
    def read(inner, resources=None):
        return pagexml.parse(page(inner), resources)[0]

    bullet, number = "<one:List><one:Bullet/></one:List>", "<one:List><one:Number/></one:List>"
    # paragraphs of one line element are lines, and their links keep their places
    one = read('<one:OE><one:T><![CDATA[<p>see <a href="https://x">it</a></p><p>b <a href="https://y">c</a></p>]]></one:T></one:OE>')["children"][0]
    assert one["text"] == "see it\nb c" and one["links"] == ["https://x", "https://y"]
    assert [one["text"][s["start"] : s["end"]] for s in one["link_spans"]] == ["it", "c"]
    # a task after a numbered item joins its list; a bullet opens another
    mixed = read(f'<one:OE>{number}<one:T>1</one:T></one:OE><one:OE><one:Tag completed="false"/><one:T>t</one:T></one:OE><one:OE>{bullet}<one:T>b</one:T></one:OE>')["children"]
    assert [(c["ordered"], [i["checked"] for i in c["items"]]) for c in mixed] == [(True, [None, False]), (False, [None])]
    # a tag without a state is no task
    assert read('<one:OE><one:Tag index="0"/><one:T>x</one:T></one:OE>')["children"][0]["kind"] == "paragraph"
    kinds = read("<one:OE><one:EmbeddedPrintout/><one:PrintoutFile/><one:FutureObject/><one:MediaFile/><one:InkWord/><one:OutlookTask/></one:OE>")["children"]
    assert [c.get("object") or c["tag"] for c in kinds] == ["printout", "printout", "unknown-object", "media", "ink", "OutlookTask"]
    # only outlines are content; numbers of media go on from what lies outside them
    outer = '<one:Page xmlns:one="x"><one:Image/><one:InkDrawing/><one:Outline><one:OEChildren><one:OE><one:Image alt=" a  b "/><one:InsertedFile preferredName="f.pdf"/></one:OE></one:OEChildren></one:Outline></one:Page>'
    media = pagexml.parse(outer, {"image:2": "h", "file:1": "g"})[0]["children"]
    assert [(c["kind"], c["reference"], c["hash"]) for c in media] == [("image", "image:2", "h"), ("attachment", "file:1", "g")] and media[0]["alt"] == "a b"
    assert pagexml.parse('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')[1] and pagexml.parse("") == (model.doc([]), [])


def test_links_without_text_and_images_between_words():
    empty = html.parse('<p><a href="https://x"></a></p>')["children"]
    assert [(c["text"], c["links"], c["link_spans"]) for c in empty] == [("", ["https://x"], [])]
    parts = html.parse('<p>a <span>b <img src="i.png"> c</span></p>')["children"]
    assert [(c["kind"], c.get("text")) for c in parts] == [("paragraph", "a b"), ("image", None), ("paragraph", "c")]
    twice = html.parse('<a href="u">x</a> <a href="u">y</a>')["children"][0]
    assert twice["links"] == ["u", "u"] and len(twice["link_spans"]) == 2
    headed = html.parse("<h2>a <img src='i'> b</h2>")["children"]
    assert [c["kind"] for c in headed] == ["paragraph", "image", "heading"]
    assert html.parse("<table><tr></tr><tr><td>a</td></tr></table>")["children"][0]["rows"] == [[{"kind": "cell", "children": [model.textual("paragraph", "a", [], [])]}]]
    assert markdown.parse("#")["children"] == [model.textual("heading", "", [], [], level=1)]
    assert markdown.parse("```py x\n1\n```")["children"][0]["language"] == "py x"
    assert model.links(markdown.parse('<b>a</b> <a href="https://u">b</a> <https://v>')) == ["https://u", "https://v"]
    assert model.text_with_spans([("\u3000a", "")])[0] == "\u3000a" and model.inline_text("a\nb") == "a b"


def test_html_blocks_in_markdown_begin_and_end_where_commonmark_has_them():
    def kinds(text):
        return [(c["kind"], c.get("text")) for c in markdown.parse(text)["children"]]

    assert kinds("<b>a</b> b\nc") == [("paragraph", "a b c")]  # a tag with text after it is inline
    assert kinds("a\n<div>b</div>\n\nc") == [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]
    assert kinds("a\n<b>\nc") == [("paragraph", "a c")] and kinds("<b>\nx\n</b>") == [("paragraph", "x")]
    assert kinds("<!-- x\n\ny -->\nz") == [("paragraph", "z")] and kinds("<pre>\na\n\nb</pre>\nc") == [("code", "a\nb"), ("paragraph", "c")]


def test_rendering_of_odd_spans_schemes_and_media(spark):
    from pyspark.sql import functions as F

    def para(spans):
        return {"kind": "paragraph", "text": "abcdef", "links": [], "link_spans": spans}

    good = {"start": 1, "end": 3, "href": "https://x"}
    for bad in ({"start": 2, "end": 4, "href": "https://y"}, {"start": 5, "end": 9, "href": "https://y"}, {"start": 4, "end": 4, "href": "https://y"}, {"href": "https://y"}, {"start": "4", "end": 5, "href": "https://y"}):
        assert render.render(para([good, bad])) == '<p>a<a href="https://x">bc</a>def</p>'
    own = para([{"start": 0, "end": 1, "href": "app://n"}])
    assert render.render(own) == "<p>abcdef</p>" and "app://n" in render.render(own, more_schemes=("app://",))
    tree = model.doc([{"kind": "image", "hash": "a" * 64, "alt": "<i>", "reference": ""}, {"kind": "attachment", "hash": "b" * 64, "name": "", "reference": ""}, {"kind": "image", "hash": None, "alt": "", "reference": ""}])
    body = render.render(tree)
    assert body == f'<img src="resource://{"a" * 64}" alt="&lt;i&gt;"><p><a href="resource://{"b" * 64}">attachment</a></p>'
    ids = F.create_map(F.lit("a" * 64), F.lit("1" * 32))
    row = spark.createDataFrame([(body,)], "b string").select(render.with_resource_ids(F.col("b"), ids).alias("b")).first()
    assert f'src=":/{"1" * 32}"' in row["b"] and f'resource://{"b" * 64}' in row["b"]


def test_empty_bodies():
    assert normalize("markdown", None)[0]["children"] == [] and normalize("odd", "x")[1]


def test_hierarchy():
    xml = """<one:Notebooks xmlns:one="x"><one:Notebook ID="n" name="N"><one:SectionGroup name="G" ID="g"><one:SectionGroup name="H" ID="h" isRecycleBin="true">
      <one:Section ID="s2" name="S2"><one:Page ID="p3" name="C"/></one:Section></one:SectionGroup><one:Section ID="s" name="S"><one:Page ID="p1" name="A"/><one:Page name="no id"/>
      <one:Page ID="p2" name="Б" pageLevel="2"/></one:Section></one:SectionGroup></one:Notebook></one:Notebooks>"""
    rows = {r["page_id"]: r for r in pagexml.hierarchy(xml)}
    assert rows["p2"]["page_order"] == 1 and rows["p2"]["page_level"] == 2 and rows["p2"]["groups"] == ["G"]
    assert rows["p3"]["in_recycle_bin"] and rows["p3"]["groups"] == ["G", "H"] and not rows["p1"]["in_recycle_bin"]


def test_bodies_go_on_in_parts(monkeypatch):
    import pyarrow as pa

    from skarn.normalize import columns

    monkeypatch.setattr(columns, "SLICE", 10)
    parts = list(columns.slices(pa.array(["abcdef", None, "ghijkl", "", "m" * 30, "n"])))
    assert parts == [(0, ["abcdef", None, "ghijkl"]), (3, ["", "m" * 30]), (5, ["n"])] and not list(columns.slices(pa.array([], pa.string())))
