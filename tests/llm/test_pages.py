"""HTML extraction and WARC derivatives."""

import base64
import gzip
import hashlib
import json
import random
import time
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from cardlens.llm import html as html_module
from cardlens.llm.html import Page, label, parse, plain_text, title
from cardlens.llm.site_style import extract_main_text, place, step
from cardlens.llm.warc import (derive, digest, inflate, page_derivatives, parse_records, read_responses, record_id, resolve,
                               response_derivatives, serialise)

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def page(k, extra=""):
    return (f"{HEAD}<nav><ul><li><a href='/a'>Home</a><li>About</ul></nav><header>Site</header><div class='ad'>Buy {k}</div>"
            f"<article><h1>Title  {k}</h1><p><b>First &amp; text\n of {k}.<br><p>Second <i>part</i> {k}&eacute;.</p>"
            f"<section class='comments'><p>nice {k}</p></section><form><p>Name</p></form>{extra}</article>"
            f"<aside>More</aside><footer>&copy; {k}</footer>")


def expected(k):
    return f"Title {k}\nFirst & text of {k}.\nSecond part {k}é."


def texts(df):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in df.collect()}


def test_article_alone_is_kept(spark):
    rows = [(k, f"http://h{k % 3}.example/{k}", page(k), "x") for k in range(30)]
    got = texts(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")))
    assert got == {k: (expected(k), len(expected(k))) for k in range(30)}


def test_unlabelled_boilerplate_is_found_by_the_site(spark):
    """No label names the strips and no element names the content: the host's pages do."""
    html = [f"<body><div class='x1'><p>Start</p><p>Contact</p></div><div class='x2'><p>Body number {k}.</p><p>Another thought {k * k}.</p></div>"
            f"<div class='x3'><p>All rights reserved</p></div>" for k in range(20)]
    df = spark.createDataFrame([(k, "http://one.example/", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    want = {k: f"Body number {k}.\nAnother thought {k * k}." for k in range(20)}
    assert texts(extract_main_text(df)) == {k: (t, len(t)) for k, t in want.items()}


def test_notice_inside_the_article_recurs_and_goes(spark):
    rows = [(k, "http://one.example/", page(k, "<p>We use your data.</p>")) for k in range(12)]
    got = texts(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert got == {k: (expected(k), len(expected(k))) for k in range(12)}


def host_texts(spark, html):
    df = spark.createDataFrame([(k, "http://one.example/", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    return {k: t for k, (t, _) in texts(extract_main_text(df)).items()}


@pytest.mark.parametrize("main", [True, False])
def test_copies_of_an_article_do_not_remove_it(spark, main):
    """11 of 20 pages carry one article, inside an article element also as near copies."""
    open_, close = ("<article>", "</article>") if main else ("<div class='x'>", "</div>")
    same = "<p>The one long text of the article that is carried again.</p><p>Its end.</p>"
    html = [f"<body>{open_}{same}{f'<p>Seen {k} times</p>' if main else ''}{close}" if k < 11 else
            f"<body>{open_}<p>Another long text with the number {k} in its middle.</p><p>End {k * k}.</p>{close}" for k in range(20)]
    got = host_texts(spark, html)
    assert all(got[k].startswith("The one long text of the article that is carried again.\nIts end.") for k in range(11))
    assert all(got[k] == f"Another long text with the number {k} in its middle.\nEnd {k * k}." for k in range(11, 20))


def test_nodes_of_few_pages_and_few_values_stay(spark):
    """A layout of two pages with one text, and a cell with four values, on hosts of any size."""
    for size in (12, 600):
        html = [f"<body><div class='x'><p>Text number {k}.</p></div><table class='facts'><tr><td>value {'abcd'[k % 4]}</table>"
                + ("<div class='own'><ul><li>Once more</li><li>Once more</li></ul></div>" if k == 3 else "") for k in range(size)]
        assert host_texts(spark, html) == {
            k: f"Text number {k}.\nvalue {'abcd'[k % 4]}" + ("\nOnce more\nOnce more" if k == 3 else "") for k in range(size)}


def test_few_pages_are_judged_by_labels_alone(spark):
    df = spark.createDataFrame([(1, "http://a.example", "<p>same</p>"), (2, "http://a.example", "<p>same</p>")], "page_id long, url string, html string")
    assert texts(extract_main_text(df)) == {1: ("same", 4), 2: ("same", 4)}


def test_nulls_broken_pages_and_repeated_rows(spark):
    rows = [(1, None, None), (2, "http://[", "<p>open <b>text"), (None, "u", ""), (4, "u", "no markup & more"), (4, "u", "no markup & more"),
            (5, "u", "<p>x</p>" * 20_000), (6, "u", "<" * 500 + "<p>t")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7 and text[1] == "" and text[None] == "" and text[2] == "open text" and text[4] == "no markup & more"
    assert text[5].count("\n") == 19_999


def test_parse_closes_open_elements():
    blocks, _ = parse("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><p>f<div>g</div>h")
    assert [t for _, t in blocks] == list("abcdefgh")


def test_svg_hides_itself_alone_and_math_is_text():
    assert plain_text("<p>a<svg class='i'/>b<p>c<svg><use/></svg>d") == "ab\ncd"
    assert plain_text("<p>a<svg><g><svg x='1'><text>no</text></svg><text>no</text></g></svg>b<svg/>c") == "abc"
    assert plain_text("<div><p>a<svg><path d='M0'><p>b<svg><g></g></div><p>c") == "a\nb\nc"
    assert plain_text("<p>E <math/>is <math><mi>m</mi><mo>+</mo><mspace/><mn>1</mn></math> here") == "E is m+1 here"
    assert plain_text("<p>a" + "<svg><g>" * 3000 + "<p>b").endswith("b")


def test_broken_attributes_stay_markup():
    assert [t for _, t in parse("<p title='it's'>a</p><p title=\"x>b</p>")[0]] == ["a", "b"]
    assert plain_text("<p a=\"1>2\">c" + "<a href=\"" * 3000).startswith("c")


@pytest.mark.parametrize("mark", ["section.share-price", "section.related-work", "p.search-engine", "div.form-factor", "div.reply-to-critics",
                                  "figure.side-by-side"])
def test_article_text_is_not_cut_by_a_word_of_a_class(spark, mark):
    assert place(f"html/body/article/{mark}") == "main"
    tag, _, name = mark.partition(".")
    html = f"<body><nav>Menu</nav><article><p>Before.</p><{tag} class='{name}'>Inside.</{tag}><div class='related-posts'>More</div></article>"
    df = spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string")
    assert texts(extract_main_text(df)) == {1: ("Before.\nInside.", 15)}


def test_whole_names_are_noise_in_an_article():
    for mark in ("div.comments", "div.related-posts", "section.user-comments", "div.share-buttons", "div.ad", "div#comment-list", "div.x.cookie-notice"):
        assert place(f"html/body/article/{mark}/p") == "noise", mark


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a \" > \"" * 100_000, "<script></script " * 60_000, "<div>x" * 15_000, "<x><table>" + "<div>" * 15_000
                                  + "</x>" * 80_000, "<i>" * 15_000 + "<div></div>" * 40_000, "<title " * 100_000, "<a b='\" " * 90_000,
                                  "<p><svg" * 90_000, "<![" * 200_000, "&" * 500_000])
def test_hostile_pages_take_linear_time(html):
    start = time.perf_counter()
    page = Page(html, step)
    assert time.perf_counter() - start < 5 and sum(len(b[0]) for b in page.blocks) < 1 << 24


def test_deep_page_through_the_operator(spark):
    html = "<div>x" * 15_000
    df = spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string")
    assert texts(extract_main_text(df)) == {1: ("\n".join("x" * 15_000), 29_999)}


class Reader(HTMLParser):
    """The standard library's tokenizer: links, title and text of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.title, self.lines, self.skip, self.head = [], "", [[]], 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.head += tag == "title"
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href"][:1]
        if tag in html_module.BLOCK:
            self.lines.append([])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.head -= tag == "title"
        if tag in html_module.BLOCK:
            self.lines.append([])

    def handle_data(self, data):
        if self.head:
            self.title += data
        elif not self.skip:
            self.lines[-1].append(data)


def well_formed(rng):
    """A page of nested elements with attributes, references and comments."""
    def inner(depth):
        made = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(6 if depth else 3)
            if kind == 0:
                made.append(rng.choice(["text ", "a &amp; b", "&eacute;t&#233;", "1 &lt; 2", "\n x\t"]))
            elif kind == 1:
                made.append(f"<a class=k href={rng.choice(['/y?a=1&amp;b=2', chr(34) + '/p &gt; q' + chr(34), chr(39) + 'x.html' + chr(39)])}>l</a>")
            elif kind == 2:
                made.append(rng.choice(["<!-- <a href='/no'>c</a> -->", "<script>var s = \"<a href='/no'>\";</script>", "<style>p{}</style>"]))
            else:
                tag = rng.choice(["div", "section", "ul", "b", "span", "blockquote"])
                made.append(f"<{tag} id='i{rng.randrange(9)}' title=\"a > b\">{inner(depth - 1)}</{tag}>")
        return "".join(made)
    return f"<html><head><title>T &amp; {rng.randrange(99)}</title></head><body>{inner(4)}</body></html>"


def test_pages_equal_the_standard_tokenizer(spark):
    """Text, title and links of op7 against a plain reader, as records of the query."""
    rng = random.Random(5)
    rows = [(k, f"http://h.example/d/{k}", well_formed(rng)) for k in range(300)]
    got = page_derivatives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    blocks = {(r["page_id"], r["warc_type"]): next(parse_records(bytes(r["record"])))[1] for r in got}
    for k, url, html in rows:
        reader = Reader()
        reader.feed(html)
        reader.close()
        lines = [" ".join("".join(line).split()) for line in reader.lines]
        assert blocks[k, "conversion"].decode() == "\n".join(x for x in lines if x)
        envelope = json.loads(blocks[k, "metadata"])["Envelope"]
        found = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert found["HTML-Metadata"] == {"Head": {"Title": reader.title}, "Links": [{"path": "A@/href", "url": urljoin(url, x)} for x in reader.links]}
        assert found["Entity-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_links_resolve_as_the_library_does():
    links = ["/a", "/a/b", "/a.b", "/.a", "/a/../b", "/a//b", "/é", "/a?b", "/a#c", "//x", "/", "/a/", "http://z/", "/a:b", "/%20", "/a b", "", "b"]
    for base in ("http://h.example/x/y?z", "https://H.x:80", "ftp://h/", "http://h;p/q", "//h/x"):
        assert resolve(base, links) == [urljoin(base, x) for x in links]
    assert resolve("http://[", ["/a"]) == ["/a"]


@pytest.mark.parametrize("charset", ["undefined", "idna", "nonsense", "punycode", "utf-8"])
def test_any_charset_is_read(charset):
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode()
    (_, envelope), (_, text) = derive({"warc-target-uri": "http://a.example/"}, head + b"<p>caf\xc3\xa9 " + b"x" * 70 + b"</p>")
    assert json.loads(envelope) and text.endswith(b"x" * 70)


def test_damaged_files_and_headers_of_any_case(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>a</p>"
    record = (b"WARC/1.1\r\nwarc-type: response\r\nwarc-record-id: <urn:uuid:9>\r\nwarc-target-uri: http://a.example/\r\n"
              b"content-length: %d\r\n\r\n" % len(block)) + block + b"\r\n\r\n"
    broken = gzip.compress(record)
    broken = broken[:20] + b"\xff" * 20 + broken[40:]
    (tmp_path / "a.warc.gz").write_bytes(broken + gzip.compress(record) + broken[:25])
    (tmp_path / "b.warc").write_bytes(record.replace(b"content-length: %d" % len(block), "Content-Length: ²".encode()))
    (tmp_path / "c.warc").write_bytes(b"")
    got = read_responses(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], bytes(r["block"])) for r in got) == [("<urn:uuid:9>", b""), ("<urn:uuid:9>", block)]
    assert {r["target_uri"] for r in got} == {"http://a.example/"}
    texts_ = [r for r in response_derivatives(read_responses(spark, str(tmp_path))).collect() if r["warc_type"] == "conversion"]
    assert len(texts_) == 2 and {r["refers_to"] for r in texts_} == {"<urn:uuid:9>"}


def test_place_of_paths():
    assert place("html/body/div.cookie-notice") == "noise"
    assert place("html/body/main/header") == "main"
    assert place("html/body/header") == "noise"
    assert place("html/body/div.site-header") == "noise"
    assert place("html/body/article/div.entry-header") == "main"
    assert place("html/body/div.headline") == "other"
    assert place("html/body/article/div.comments/p") == "noise"


def test_labels():
    assert label("div", " CLASS='userComments box12' id=\"x\" data-class='y'") == "div.box.user-comments#x"
    assert place("body/" + label("div", "class=userComments")) == "noise"


def test_title_and_plain_text():
    assert title("<title> A &amp;\n B</title>") == "A & B"
    assert plain_text("<p>a</p><script>x</script><p>b") == "a\nb"


# --- WARC --------------------------------------------------------------------

def test_page_derivatives_are_linked(spark):
    rows = [(1, "http://a.example/x", "<title>T é</title><p>Hello</p><a href='/y'>l</a>", 1), (2, None, None, 1), (1, "http://a.example/x", "", 1)]
    got = page_derivatives(spark.createDataFrame(rows, "page_id long, url string, html string, record_id int")).collect()
    assert len(got) == 6
    meta = next(r for r in got if r["page_id"] == 1 and r["warc_type"] == "metadata" and "T é".encode() in r["record"])
    text = next(r for r in got if r["page_id"] == 1 and r["warc_type"] == "conversion" and b"Hello" in r["record"])
    assert meta["refers_to"] == text["refers_to"] == record_id("1 http://a.example/x")
    assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] is None
    (headers, block), = parse_records(bytes(meta["record"]))
    assert headers["WARC-Refers-To"] == meta["refers_to"] and headers["WARC-Block-Digest"] == digest(block)
    envelope = json.loads(block)["Envelope"]
    assert envelope["WARC-Header-Metadata"]["WARC-Payload-Digest"] == meta["source_payload_digest"]
    head = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert head["HTML-Metadata"]["Head"]["Title"] == "T é" and head["HTML-Metadata"]["Links"] == [{"path": "A@/href", "url": "http://a.example/y"}]
    (headers, block), = parse_records(bytes(text["record"]))
    assert block == b"Hello\nl"


def test_warc_files_round_trip(spark, tmp_path):
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-A: b\r\n\r\n".encode() + "<p>caf\xe9</p>".encode("latin-1")
    source = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a.example/", "WARC-Date": "2024-01-01T00:00:00Z",
              "WARC-Payload-Digest": "sha1:ABC", "Content-Length": str(len(block))}
    info = serialise({"WARC-Type": "warcinfo", "Content-Length": "4"}, b"a: b")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(serialise(source, block)))
    (tmp_path / "b.warc").write_bytes(serialise({**source, "WARC-Record-ID": "<urn:uuid:2>"}, block))
    responses = read_responses(spark, str(tmp_path))
    assert {r["record_id"]: (r["headers"], bytes(r["block"])) for r in responses.collect()} == {
        "<urn:uuid:1>": (source, block), "<urn:uuid:2>": ({**source, "WARC-Record-ID": "<urn:uuid:2>"}, block)}
    got = response_derivatives(responses).collect()
    assert sorted((r["refers_to"], r["warc_type"]) for r in got) == [(f"<urn:uuid:{k}>", t) for k in "12" for t in ("conversion", "metadata")]
    for r in got:
        assert r["source_payload_digest"] == "sha1:ABC" and r["target_uri"] == "http://a.example/"
        if r["warc_type"] == "conversion":
            assert next(parse_records(bytes(r["record"])))[1].decode() == "café"


@pytest.mark.parametrize("coding", ["gzip", "deflate", "br", "zstd", "identity"])
@pytest.mark.parametrize("chunked", [True, False])
def test_codings_of_a_response_are_undone(coding, chunked):
    import pyarrow as pa
    html = "<title>T</title><p>Hello</p><a href='/y'>l</a>".encode()
    body = {"gzip": gzip.compress, "deflate": zlib.compress, "identity": bytes}.get(
        coding, lambda x: pa.compress(x, {"br": "brotli"}.get(coding, coding), asbytes=True))(html)
    head = f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n" + "Transfer-Encoding: chunked\r\n" * chunked + "\r\n"
    sent = b"".join(b"%x\r\n%s\r\n" % (len(body[k:k + 9]), body[k:k + 9]) for k in range(0, len(body), 9)) + b"0\r\n\r\n" if chunked else body
    for payload in (sent, html):  # archives also keep the headers of bodies that they have decoded
        (_, envelope), (_, text) = derive({"WARC-Target-URI": "http://a.example/"}, head.encode() + payload)
        found = json.loads(envelope)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert text == b"Hello\nl" and found == {"Head": {"Title": "T"}, "Links": [{"path": "A@/href", "url": "http://a.example/y"}]}


def test_batches_of_responses_are_bounded_and_whole(spark, tmp_path):
    made = [(f"<urn:{i}>", bytes([65 + i % 26]) * (i * 37 % 5000)) for i in range(300)]
    record = lambda i, b, kind: serialise({"WARC-Type": kind, "WARC-Record-ID": i, "Content-Length": str(len(b))}, b)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b, "response") + record(i + "q", b, "request")) for i, b in made))
    (tmp_path / "none.warc").write_bytes(b"")
    got = read_responses(spark, str(tmp_path), batch_bytes=10_000).collect()
    assert [(r["record_id"], bytes(r["block"])) for r in got] == made


def test_many_gzip_members_are_inflated_once():
    member = gzip.compress(b"abc\n")
    assert inflate(member * 100_000, 50) == b"abc\n" * 100_000
    assert inflate(member + gzip.compress(bytes(range(256)) * 999)[:-9])[:5] == b"abc\n\0"


@pytest.mark.parametrize("operator", [extract_main_text, page_derivatives])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
