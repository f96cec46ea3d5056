"""HTML extraction and WARC archives."""

from __future__ import annotations

import hashlib

import pytest
import zstandard
from compare import same

from corpusmill.llm import html_text, warc


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain", "plain"), ("a  \n b", "a b"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"),
        ("a<b>b</b> <i> c</i>d", "ab cd"), ("<h1>T</h1>x", "T\n\nx"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=3><li>p<li value=9>q<li>r</ol>", "3. p\n9. q\n10. r"),
        ("<table><tr><th>n<th>value<tr><td>one<td>2</table>", "n    value\none  2"), ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"), ("<table><caption>C</caption><tr><td>a<br>b<td>c</table>", "C\na  c\nb"),
        ("<pre>  a\n   b</pre>", "  a\n   b"), ("x<script>var a='</p>';</script>y", "xy"), ("<style>p{}</style>a<!-- b -->c", "ac"), ("<head><title>t</title></head><body>b", "b"),
        ("a<span hidden>b</span><div style='display: none'>c</div>d", "ad"), ("<p style='color:red'>a</p>", "a"), ("&lt;a&gt; &eacute;&nbsp;x &#65;", "<a> é\xa0x A"), ("a < b", "a < b"), ("<a href='x>y'>t</a>", "t"), ("<p>a</p></p>b</div>", "a\n\nb"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"), ("<blockquote>q</blockquote>a", "  q\n\na"), ("<!-- open", ""), ("<script>open", ""), ("a<", "a<"), ("<div>" * 3000 + "x", "x"), ("<p>a" * 300, "\n\n".join("a" * 300)),
        ("<textarea><b>raw</b></textarea>", "<b>raw</b>"), ("<html><head><meta a><body hidden>x", ""), ("<select><option>a</select>b", "b"),
    ],
)
def test_layout(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>aaa<td>b<tr><td>c</table>", "aaa  b\n     c"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"), ("<table><tbody><tr><td rowspan=9>a<tbody><tr><td>b</table>", "a\nb"),
        ("<details><summary>s</summary>no</details>a", "s\na"), ("<details open><summary>s</summary>b</details>", "s\nb"), ("<details>no</details>a", "a"),
        ("<dialog>no</dialog>a<dialog open>b</dialog>", "a\nb"), ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"), ("<p style='visibility: hidden'>no<p>a", "a"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>b</ul>", "- b"), ("<span style='visibility:collapse'>no</span>a", "a"),
    ],
)
def test_visibility_and_spans(page, text):
    assert html_text.visible_text(page) == text


def _random_page(rng, depth=0):
    """A tree of tuples (tag, children) and words."""
    out = []
    for _ in range(rng.integers(1, 4)):
        kind = rng.choice(["word", "word", "b", "br", "div", "p", "ul", "ol", "hidden", "script"] if depth < 3 else ["word", "b", "br"])
        if kind == "word":
            out.append(" " + rng.choice(["one", "two", "three", "four"]) + " ")
        elif kind in ("br", "script"):
            out.append((kind, []))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", _random_page(rng, depth + 1)) for _ in range(rng.integers(1, 3))]))
        else:
            out.append((kind, _random_page(rng, depth + 1)))
    return out


def _html(node, rng):
    if isinstance(node, str):
        return node
    tag, children = node
    inside = "".join(_html(c, rng) for c in children)
    if tag == "br":
        return "<br>"
    if tag == "script":
        return "<script>if (a < b) '<p>no'</script>"
    if tag == "hidden":
        return f"<div style='display:none'>{inside}</div>"
    if tag == "li" and rng.random() < 0.5:
        return f"<li>{inside}"  # its end tag is implied
    return f"<{tag}>{inside}</{tag}>"


def _brute_lines(children):
    """The lines of a tree by plain recursion: GAP stands for a blank line between blocks, None for the end of a line."""
    events = []

    def walk(nodes, parent):
        for node in nodes:
            if isinstance(node, str):
                events.append(node)
                continue
            tag, inner = node
            if tag == "br":
                events.append("BR")
            elif tag in ("hidden", "script"):
                continue
            elif tag == "b":
                walk(inner, tag)
            elif tag in ("ul", "ol"):
                gap = parent != "li"
                lines = []
                for k, (_, item) in enumerate(inner, 1):
                    mark = "- " if tag == "ul" else f"{k}. "
                    first, *rest = _brute_lines_of(item, "li") or [""]
                    lines += [(mark + first).rstrip()] + [" " * len(mark) + x if x else "" for x in rest]
                events.extend([("END", gap), ("WHOLE", lines), ("END", gap)])
            else:
                gap = tag == "p"
                events.append(("END", gap))
                walk(inner, tag)
                events.append(("END", gap))

    def lines_of():
        lines, line, gap = [], None, False

        def begin():
            nonlocal gap
            if gap and lines and lines[-1] != "":
                lines.append("")
            gap = False

        for e in events:
            if isinstance(e, tuple) and e[0] == "END":
                if line is not None:
                    lines.append(" ".join(line))
                line = None
                gap = gap or e[1]
            elif isinstance(e, tuple):
                if e[1]:
                    begin()
                    lines.extend(e[1])
            elif e == "BR":
                if line is not None:
                    lines.append(" ".join(line))
                    line = None
                elif lines:
                    begin()
                    lines.append("")
            else:
                if line is None:
                    begin()
                    line = []
                line.append(e.strip())
        if line is not None:
            lines.append(" ".join(line))
        return lines

    return walk, lines_of


def _brute_lines_of(children, parent):
    walk, lines_of = _brute_lines(children)
    walk(children, parent)
    lines = lines_of()
    while lines and not lines[-1].strip():
        lines.pop()
    while lines and not lines[0].strip():
        lines.pop(0)
    return lines


def test_layout_by_brute_force():
    """Random pages against a plain recursive renderer of their trees."""
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(400):
        page = _random_page(rng)
        if any(isinstance(n, tuple) and n[0] == "p" and _has_block(n[1]) for n in _walk(page)):
            continue  # a block ends a paragraph
        text = "".join(_html(n, rng) for n in page)
        assert html_text.visible_text(text) == "\n".join(x.rstrip() for x in _brute_lines_of(page, "body")), text


def _walk(nodes):
    for n in nodes:
        yield n
        if isinstance(n, tuple):
            yield from _walk(n[1])


def _has_block(nodes):
    return any(isinstance(n, tuple) and n[0] in ("div", "p", "ul", "ol", "hidden") for n in _walk(nodes))


def test_extraction_operator(spark):
    rows = spark.createDataFrame([(1, "<p>a<p>b", "t"), (2, None, "t"), (2, None, "t"), (None, "x", "t"), (3, "<i>long</i> " * 20_000, "t")], "page_id long, html string, text string")
    got = html_text.extracted(rows)
    by = sorted(((r["page_id"] or 0), r["text"][:9], r["n_lines"]) for r in got.collect())
    assert by == [(0, "x", 1), (1, "a\n\nb", 3), (2, "", 0), (2, "", 0), (3, "long long", 1)]
    assert html_text.extracted(rows.where("false")).count() == 0


def test_extraction_query(spark, sf):
    got = html_text.op4_html_text(spark, sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    assert len(got) == len(pages)
    assert not got.text.str.contains(r"track\(|margin:0", regex=True).any()


BIG = "<p>" + "many words here " * 100


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", f"<p>page {i} " + "text é " * (20 * i)) for i in range(30)]
    rows += [(100, "u", BIG), (101, None, BIG), (102, "u", BIG), (102, "u", BIG), (None, "u", BIG), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (106, "u", ""), (107, "u", "x\r\n\r\ny\r\nContent-Length: 5")]
    return spark.createDataFrame([(*r, "d", "r") for r in rows], "page_id long, url string, html string, digest string, refers_to string")


def brute(rows):
    tops = {}
    for p, h in rows:
        if len(h.encode()) >= 1000 and p is not None:
            tops[h] = max(p, tops.get(h, p))
    out = []
    for p, h in rows:
        top = tops.get(h)
        revisit = top is not None and p != top
        out.append((p or -1, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", top if revisit else -1))
    return sorted(out)


def test_archives(spark, pages, tmp_path):
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    got = warc.archived(pages)
    assert sorted((r[0] or -1 if r[0] != 0 else -1, *r[1:4], -1 if r[4] is None else r[4]) for r in got.collect()) == sorted((a if a != 0 else -1, *b) for a, *b in brute(rows))
    assert warc.archived(pages.where("false")).count() == 0
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    assert sum(r["pages"] for r in manifest) == len(rows)
    files = spark.createDataFrame([(r["file"],) for r in manifest], "file string")
    payloads = warc.read_archives(files, payloads=True).where("record_type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in payloads} == {h for _, h in rows}


def test_archive_has_its_dictionary():
    records = [warc.page_record(i, "u", f"<html><body><p>{'common words of a page ' * 5}{i}</p>".encode(), None) for i in range(500)]
    content = warc.archive(records)
    magic, size = warc._SKIPPABLE.unpack_from(content)
    assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY
    words = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    frames, rest = 0, content[8 + size :]
    while rest:  # every record is a frame of its own
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert d.decompress(rest).startswith(b"WARC/1.1\r\n")
        frames, rest = frames + 1, d.unused_data
    assert frames == 501
    assert [h["warc-type"] for h, _ in warc.records_of(content)] == ["warcinfo"] + ["response"] * 500
    few = warc.archive(records[:1])
    assert len(list(warc.records_of(few))) == 2


def test_long_records_leave_a_dictionary():
    """Archives of few and long records, or with a long one in front, have their dictionary too."""
    page = lambda n: (f"<p>{'common words of a page ' * 9}{n}</p>" * (n // 200)).encode()
    for sizes in ([1_500_000], [400_000] * 3, [250_000] * 5, [2_000_000, *[3000] * 50]):
        content = warc.archive([warc.page_record(i, "u", page(n), None) for i, n in enumerate(sizes)])
        assert warc._SKIPPABLE.unpack_from(content)[0] == warc._MAGIC
        assert len(list(warc.records_of(content))) == len(sizes) + 1


def test_archives_roll_over(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 5000)
    records = [warc.page_record(i, "u", b"x" * 1000, None) for i in range(20)]
    made = list(warc.compressed(iter(records)))
    assert len(made) > 3 and sum(n for _, n in made) == 20


def test_damage_is_found():
    ok = list(warc.records_of(warc.archive([warc.page_record(1, "u", b"abc", None)])))[1]
    assert warc.page_of(*ok)[:5] == (1, 3, hashlib.sha1(b"abc").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        warc.page_of(ok[0], ok[1][:-1] + b"z")


def test_warc_query(spark, sf, duck):
    same(warc.op6_warc(spark, sf).toPandas(), duck.sql(warc.SQL).df())


@pytest.mark.parametrize("depth", [160, 5000, 50_000])
def test_depth_changes_nothing(depth):
    """Behind many open elements hidden text stays hidden, lists and tables keep their form, end tags close their own."""
    inner = "<div hidden>no<b>no</b></div><noscript>no</noscript><ul><li>a</ul><table><tr><td>b<td>c</table><blockquote>q</blockquote>"
    for opened in ("<b>", "<span>", "<font>"):
        assert html_text.visible_text(opened * depth + inner) == "- a\n\nb  c\n\n  q"
    assert html_text.visible_text("<div hidden>" + "<i>" * depth + "</i>" * depth + "no</div>yes") == "yes"


def test_deep_tables():
    assert html_text.visible_text("<table><tr><td>" * 500 + "x") == "x"
