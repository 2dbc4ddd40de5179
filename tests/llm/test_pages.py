"""HTML extraction and WARC archives."""

import base64
import hashlib
import html
import random
import re

import pytest

from gapgraph.llm import html_extract, warc
from gapgraph.llm.common import Stages

PAGE = "page_id long, url string, html string, host string, skeleton string, value binary"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGE)


def extract(df, **how):
    return {r.page_id: r.text for r in html_extract.extract_main_text(df, **how).collect()}


def article(source):
    """The blocks of the one article element that every page of the tables has."""
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", source)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n\n".join(x for x in blocks if x)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_extract.extract_main_text(df).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == {r.page_id: (r.url, article(r.html)) for r in df.collect()}
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("elements", ["article", "article|nav|footer"])
def test_table_without_marks(spark, sf, elements):
    """Pages whose elements and classes say little or nothing: the wrapper finds the article, what stands outside marked elements doesn't make it."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    plain = [re.sub(rf"<(/?)(?:{elements})\b", r"<\1div", r.html).replace(' class="ad"', "") for r in rows]
    got = extract(pages(spark, [(r.page_id, r.url, x) for r, x in zip(rows, plain, strict=True)]))
    assert sum(got[r.page_id] == article(r.html) for r in rows) >= 0.95 * len(rows)
    for r, x in zip(rows, plain, strict=True):
        _, blocks, flags = html_extract.read_page(x)
        assert "\n\n".join(t for (_, t, _), f in zip(blocks, flags, strict=True) if not f & 1) != article(r.html)


def site(k, body, host="h.example"):
    """A page without an article element; its template is only known by the other pages."""
    return (
        k,
        f"https://{host}/{k}",
        f"""<html><head><title>T{k}</title><script>if (a < b) {{ "</p>" }}</script></head><body>
        <div class="top"><div>Daily Planet</div><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></div>
        <div class="cookie-notice">We use cookies {k}</div>
        <div class="text">{body}<div>Share this story with friends</div></div>
        <aside>Popular {k}</aside><form>Search {k}<input></form>
        <div id="comments"><p>reader{k}: nice</p></div><div>All rights reserved</div></body></html>""",
    )


def test_wrapper_by_host(spark):
    rows = [site(k, f"<h1>Title {k}</h1><p>First of {k} &amp; more<br>after a break</p><p>Second   <i>of</i> {k}</p>" + f"<p>Third {k}</p>" * (k % 3)) for k in range(8)]
    got = extract(pages(spark, rows))
    for k in range(8):
        assert got[k].split("\n\n") == [f"Title {k}", f"First of {k} & more after a break", f"Second of {k}", *[f"Third {k}"] * (k % 3)]


def test_joined_by_host(spark):
    rows = [site(k, f"<p>Body {k}</p>") for k in range(8)]
    assert extract(pages(spark, rows), broadcast_bytes=0) == {k: f"Body {k}" for k in range(8)}


@pytest.mark.parametrize("element", ["article", "div"])
@pytest.mark.parametrize("others", [4, 0])
def test_near_copies_of_an_article(spark, element, others):
    shared = ["The title of the story", *(f"Paragraph {j} of the story. It has sentences of its own, as all pages of it say. Number {j}." for j in range(6))]

    def page(k, parts):
        inner = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
        return k, f"https://copies.example/{k}", f"<body><div class=top>Daily Planet</div><{element}>{inner}</{element}><div class=end>All rights reserved</div></body>"

    bodies = {k: [*shared[:3], f"Our reporter {k} was there.", *shared[3:]] for k in range(6)}
    bodies |= {6 + k: [f"Title {k}", *(f"Own text {k} of paragraph {j}. No other page has it." for j in range(5)), shared[1]] for k in range(others)}
    assert extract(pages(spark, [page(k, b) for k, b in bodies.items()])) == {k: "\n\n".join(b) for k, b in bodies.items()}


def test_near_copies_with_a_slot_for_each_paragraph(spark):
    def page(k):
        parts = [f"<p class=c{j}>Paragraph {j} of a story. All copies have it." for j in range(6)]
        parts[2] = f"<p class=c2>Our reporter {k} was there."
        return k, "https://each.example/", f"<body><div>Site</div><article><h1>Title of it</h1>{''.join(parts)}</article></body>"

    for k, text in extract(pages(spark, [page(k) for k in range(6)])).items():
        want = [f"Paragraph {j} of a story. All copies have it." if j != 2 else f"Our reporter {k} was there." for j in range(6)]
        assert text.split("\n\n") == ["Title of it", *want]


@pytest.mark.parametrize("element", ["article", "div class=story"])
def test_constant_slot_in_the_article_is_template(spark, element):
    def page(k):
        own = "".join(f"<p>Sentence {j} of page {k}. It is like no other, {k}.</p>" for j in range(3))
        return k, "https://tpl.example/", f"<body><div>Site</div><{element}><h1>Head {k}</h1><div>Share this story with friends</div>{own}</{element.split()[0]}></body>"

    for n in (2, 9):
        got = extract(pages(spark, [page(k) for k in range(n)]))
        assert got == {k: "\n\n".join([f"Head {k}", *(f"Sentence {j} of page {k}. It is like no other, {k}." for j in range(3))]) for k in range(n)}
    # one page proves nothing
    assert "Share this story" in extract(pages(spark, [page(1)]))[1]


def test_copies_make_no_template(spark):
    same = "<p>First of a story</p><p>Second of it</p>"
    rows = [site(k, same) for k in range(10)] + [site(10, "<p>Body 10</p><p>First of a story</p>")] + [site(k, f"<p>Body {k}. It is short.</p>") for k in range(11, 18)]
    got = extract(pages(spark, rows))
    assert got[3] == "First of a story\n\nSecond of it" and got[10] == "Body 10\n\nFirst of a story" and got[12] == "Body 12. It is short."


def test_odd_pages(spark):
    art = "<article><header><h1>Head</h1></header><nav>menu</nav><p>One<p>Two <b>bold<ul><li>a<li>b</ul><section class='comments'><p>troll</p></section></article><footer>f</footer>"
    rows = [(1, "https://one.example/", art), (2, None, "<p>plain &lt;text&gt;"), (3, "http://[bad", None), (4, "x", ""), (5, "y", "no tags\n at all"), (5, "y", "no tags\n at all"), (None, "z", "<table><tr><td>c1<td>c2</table>"), (6, "q", "<p title='a > b'>quoted</p><!-- <p>gone</p> --><p>a<script>x</script>b</p>")]
    got = sorted(((r.page_id, r.text) for r in html_extract.extract_main_text(pages(spark, rows)).collect()), key=repr)
    want = [(1, "Head\n\nOne\n\nTwo bold\n\na\n\nb"), (2, "plain <text>"), (3, ""), (4, ""), (5, "no tags at all"), (5, "no tags at all"), (None, "c1\n\nc2"), (6, "quoted\n\nab")]
    assert got == sorted(want, key=repr)
    assert extract(pages(spark, [])) == {}


def test_roles_and_names():
    page = """<body><div class="siteHeader">site</div><div class=header>top</div><main><p>crumb</p><article><div class="article-header"><h1>Head</h1></div>
    <p>Text<button>Buy</button></p><div style="display: none">secret</div><p hidden>gone</p><div class="newsletter-box">join</div><select><option>x</select></article></main></body>"""
    assert html_extract.main_text(page) == "Head\n\nText"
    assert html_extract.main_text("<header>h</header><main><p>only main</p></main><p>other</p>") == "only main"
    # a mark that holds little of the text is not believed
    assert html_extract.main_text("<div><h1>Head</h1><p>A long text of the page, which has a teaser</p></div><article><p>teaser</p></article>") == "Head\n\nA long text of the page, which has a teaser"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<h1>Head</h1><p>Text"
    wide = "<h1>Head</h1>" + "".join(f"<div class=c{i}><p>block {i}</p></div>" if i % 2 else f"<p>block {i}" for i in range(20000))
    rows = [(k, f"https://odd{k}.example/" if k > 2 else "https://odd.example/", x) for k, x in enumerate([deep, deep.replace("Text", "Other").replace("Head", "Title"), wide, wide.replace("block 7<", "other<"), "<i>" * 5000 + "x"])]
    got = extract(pages(spark, rows))
    assert got[0] == "Head\n\nText" and got[1] == "Title\n\nOther" and got[4] == "x"
    assert got[2].split("\n\n") == ["Head", *(f"block {i}" for i in range(20000))] and "other" in got[3]


def tree(nested):
    labels, parents = [], []
    def walk(node, parent):
        labels.append(node[0])
        parents.append(parent)
        at = len(labels) - 1
        for kid in node[1:]:
            walk(kid, at)
    walk(nested, -1)
    return html_extract.Tree(labels, parents)


def largest(a, b):
    """The size of the largest match, by trying for each child to leave it or pair it."""
    if a[0] != b[0]:
        return 0
    def rows(x, y):
        if not x or not y:
            return 0
        return max(rows(x[1:], y), rows(x, y[1:]), (s := largest(x[0], y[0])) and s + rows(x[1:], y[1:]))
    return 1 + rows(a[1:], b[1:])


def test_tree_matching_by_brute_force():
    rng = random.Random(7)
    def some(depth):
        return (rng.choice("ab"), *(some(depth - 1) for _ in range(rng.randrange(4) if depth else 0)))
    for _ in range(300):
        a, b = ("r", *(some(2) for _ in range(3))), ("r", *(some(2) for _ in range(3)))
        x, y = tree(a), tree(b)
        matched = html_extract.Aligner().match(x, y)
        assert sum(m >= 0 for m in matched) == largest(a, b)
        for i, m in enumerate(matched):
            if m >= 0:
                assert x.labels[i] == y.labels[m] and (x.parents[i] < 0 or matched[x.parents[i]] == y.parents[m])
        used = [m for m in matched if m >= 0]
        assert used == sorted(set(used))
        # the way for very wide elements keeps order and labels too
        few = [m for m in html_extract.Aligner(full_pairs=0).match(x, y) if m >= 0]
        assert few == sorted(set(few)) and len(few) <= len(used)
    assert html_extract.Tree.read(x.write()).parents == x.parents


def test_tree_matching_of_wide_elements():
    """Children are aligned by one rule, however many there are and however few rows of their table are held."""
    rng = random.Random(8)
    for n in (40, 700):
        a, b = [rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(n)]
        row = [0] * (n + 1)
        for p in a:
            above, row = row, [0]
            for j, q in enumerate(b):
                row.append(above[j] + 1 if p == q else max(above[j + 1], row[j]))
        x, y = tree(("r", *((c,) for c in a))), tree(("r", *((c,) for c in b)))
        found = [html_extract.Aligner(full_pairs=k).match(x, y) for k in (0, 5000, 1 << 40)]
        assert found[0] == found[1] == found[2] == html_extract.Aligner().match(x, y)
        used = [m for m in found[0] if m >= 0]
        assert len(used) == 1 + row[-1] and used == sorted(set(used))
    for _ in range(100):
        a, b = (("r", *((rng.choice("ab"), *((rng.choice("ab"),) for _ in range(rng.randrange(3)))) for _ in range(5))) for _ in range(2))
        matched = html_extract.Aligner(full_pairs=0).match(tree(a), tree(b))
        assert sum(m >= 0 for m in matched) == largest(a, b)


def archive(spark, rows, **how):
    path = f"{Stages(spark, 'w').root}/a"
    warc.write_archives(pages(spark, rows), path, **how)
    return path


def round_trip(spark, rows):
    path = archive(spark, rows)
    return sorted((tuple(r) for r in warc.resolve(warc.read_archives(spark, path)).collect()), key=repr)


def test_warc_round_trip(spark):
    big = "<p>é same " * 40
    rows = [(5, "http://a/ b\r\n", big), (2, "u", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (7, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" + "y" * 100)]
    got = round_trip(spark, rows)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h == big and i != 2
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=repr)


def test_warc_of_no_pages_and_null_ids(spark):
    assert round_trip(spark, []) == []
    same = "z" * 200
    got = round_trip(spark, [(None, "u", same), (3, "u", same), (3, "u", same)])
    assert [(r[0], r[3], r[4]) for r in got] == [(3, "response", None), (3, "response", None), (None, "revisit", 3)]


def test_payload_is_kept(spark):
    path = archive(spark, [(1, "u", "päyload")])
    row = warc.read_archives(spark, path).first()
    assert (row.payload.decode(), row.payload_bytes, row.target_uri) == ("päyload", 8, "u")


@pytest.fixture
def records():
    return [warc.build_record(k, f"http://x/{k}", f"payload {k} ".encode() * (k + 3), hashlib.sha256(f"payload {k} ".encode() * (k + 3)).hexdigest(), None) for k in range(12)]


def names(found):
    return [f["warc-record-id"] for _, _, s, f, _ in found if s == "ok"]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(records, packed):
    parts = [warc.gzip_member(r) for r in records] if packed else records
    starts = [sum(map(len, parts[:k])) for k in range(12)]
    whole = b"".join(parts)
    assert names(warc.salvage(whole)) == [warc.record_name(k) for k in range(12)]
    hurt = bytearray(whole)
    hurt[starts[3] + len(parts[3]) // 2] ^= 0xFF
    cut = bytes(hurt[: starts[7] + 9]) + b"garbage" + bytes(hurt[starts[8] : starts[11] + 20])
    found = list(warc.salvage(cut))
    assert names(found) == [warc.record_name(k) for k in (0, 1, 2, 4, 5, 6, 8, 9, 10)]
    at = 0
    for start, end, *_ in found:  # records and gaps cover the archive
        assert start == at
        at = end
    assert at == len(cut)
    assert [(s, e) for s, e, status, *_ in found if status != "ok"][0] == (starts[3], starts[4])


@pytest.mark.parametrize("how", ["hex", "base32"])
def test_damage_under_a_sha1_block_digest(how):
    def record(k):
        block = f"HTTP/1.1 200 OK\r\n\r\nbody {k}".encode()
        digest = hashlib.sha1(block).digest()
        value = digest.hex() if how == "hex" else base64.b32encode(digest).decode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {warc.record_name(k)}\r\nWARC-Block-Digest: sha1:{value}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    own = [record(k) for k in range(3)]
    assert names(warc.salvage(b"".join(own))) == [warc.record_name(k) for k in range(3)]
    own[1] = own[1].replace(b"body 1", b"b0dy 1")
    found = list(warc.salvage(b"".join(own)))
    assert names(found) == [warc.record_name(0), warc.record_name(2)] and [x[2] for x in found if x[2] != "ok"] == ["the block digest differs"]


def test_very_long_payload(spark):
    big = "0123456789abcdef" * (17 << 16)
    assert round_trip(spark, [(1, "u", big), (2, "u", big)]) == [(1, len(big), hashlib.sha256(big.encode()).hexdigest(), "response", None), (2, len(big), hashlib.sha256(big.encode()).hexdigest(), "revisit", 1)]


def test_salvage_of_noise(records):
    rng = random.Random(0)
    for _ in range(20):
        hurt = bytearray(b"".join(records))
        for _ in range(5):
            hurt[rng.randrange(len(hurt))] = rng.randrange(256)
        found = list(warc.salvage(bytes(hurt)))
        assert len(names(found)) >= 7
    assert list(warc.salvage(b"")) == []


def test_salvage_of_plain_records_beside_gzip_bytes(records):
    inner = warc.gzip_member(b"a body " * 50)
    zipped = warc.build_record(99, "http://x/z", inner, "", None)
    hurt = b"X" + records[0][1:] + zipped + b"".join(records[1:4])
    found = list(warc.salvage(hurt))
    assert names(found) == [warc.record_name(k) for k in (99, 1, 2, 3)]
    assert [(s, e) for s, e, status, *_ in found if status != "ok"] == [(0, len(records[0]))]
    # the gzip bytes of a record that is itself broken are no member of the archive
    found = list(warc.salvage(b"X" + zipped[1:] + records[1]))
    assert [(s, e, status == "ok") for s, e, status, *_ in found] == [(0, len(zipped), False), (len(zipped), len(zipped) + len(records[1]), True)]
    # plain records between members, and members after plain records
    mixed = [warc.gzip_member(records[0]), b"junk", records[1], warc.gzip_member(records[2])]
    assert names(warc.salvage(b"".join(mixed))) == [warc.record_name(k) for k in range(3)]
    assert names(warc.salvage(records[3] + b"".join(mixed))) == [warc.record_name(k) for k in (3, 0, 1, 2)]


@pytest.mark.parametrize("how", ["cut", "byte", "checksum"])
def test_salvage_of_one_broken_member(how):
    rng = random.Random(2)
    own = [warc.build_record(k, "u", (body := rng.randbytes(2000)), hashlib.sha256(body).hexdigest(), None) for k in range(12)]
    member = bytearray(warc.gzip_member(b"".join(own)))
    if how == "cut":
        member = member[: len(member) * 3 // 4]
    elif how == "byte":
        member[len(member) * 3 // 4] ^= 0xFF
    else:
        member[-6] ^= 0xFF
    found = list(warc.salvage(bytes(member) + warc.gzip_member(warc.build_record(50, "u", b"last", "", None))))
    want = {"cut": 8, "byte": 8, "checksum": 12}[how]
    assert names(found)[:want] == [warc.record_name(k) for k in range(want)] and names(found)[-1] == warc.record_name(50)
    assert [(s, e) for s, e, status, *_ in found if status != "ok"] == [(0, len(member))]


def test_gaps_are_rows(spark, tmp_path, records):
    (tmp_path / "part-0").write_bytes(records[0] + b"junk" + records[1])
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    log = warc.quarantine(warc.read_archives(spark, str(tmp_path))).collect()
    assert [(r.offset, r.length, r.reason) for r in log] == [(len(records[0]), 4, "no record head")] and log[0].archive.endswith("part-0")
    assert [(r.offset, r.length, r.status == "ok") for r in rows] == [(0, len(records[0]), True), (len(records[0]), 4, False), (len(records[0]) + 4, len(records[1]), True)]
