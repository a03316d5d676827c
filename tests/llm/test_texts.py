"""Tokens, quality, secrets, pages and shards against the libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import html_extract
from tidelog.llm.bpe import bpe_encode_decode, byte_bpe
from tidelog.llm.html_extract import SAME_CLASS, SAME_TEXT, Page, extract_pages, main_text, match
from tidelog.llm.quality import PRIOR, PRIOR_CHAIN, judge_documents, keep_good, train, viterbi
from tidelog.llm.secrets import DIGITS, redact_secrets, scan_secrets, spans_of
from tidelog.llm.sharding import shard_documents
from tidelog.llm.tokenfile import WaveletFile, WordEncoder, read_token_files, write_token_files, write_wavelet

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "a   b", "x\n \ny", "a \nb", "don't I'LL 'tis", "aaaaaaaaaa " * 5, "<|endoftext|>a<|endoftext|><|startoftext|> b", "  x 　y", "a\x1cb \x1c c", "é" * 50, "x" * 3000, " \t\ta  \n\n b ", "日本語 ٣٤ ½", "a\x0bb \x0b x", "a\xa0b \xa0c", "ΣΑΣ é. ≠"]
NASTY = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string, spans string"


@pytest.fixture(scope="module")
def texts():
    return [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls, empty and repeated rows, ties, a very long text and columns whose names clash with results."""
    rows = [(1, None, None, None, None, "x", "y", "z"), (2, "", "", "", 0, "x", "y", "z"), (None, "no id here at all", None, None, 3, None, None, None), (3, "same text", "en", "s", 9, "", "", ""), (3, "same text", "en", "s", 9, "", "", ""), (4, "same text", "en", "s", 9, "", "", ""), (5, "long words and more. " * 20000, "en", "s", 1, "", "", "")]
    return spark.createDataFrame(rows, NASTY)


def split(ids, lengths):
    ends = np.cumsum(np.r_[0, lengths])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


@pytest.mark.parametrize(("codec", "path"), [(byte_bpe(BYTE), BYTE), (WordEncoder(WORD), WORD)], ids=["byte", "word"])
def test_encoders_agree_with_the_library(texts, codec, path):
    library, all_texts = Tokenizer.from_file(path), [*texts, *ODD]
    for _ in range(2):  # with new units, then with known ones
        found = split(*codec.encode_batch([t.encode() for t in all_texts]))
        assert found == [e.ids for e in library.encode_batch(all_texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé'st.,!\n\t  \x0b\x1c1²ß日<|endoftext|>")), max_size=25), max_size=4))
def test_encoders_agree_on_any_text(some):
    for codec, path in ((byte_bpe(BYTE), BYTE), (WORDS, WORD)):
        assert split(*codec.encode_batch([t.encode() for t in some])) == [e.ids for e in LIBRARY[path].encode_batch(some, add_special_tokens=False)]


WORDS, LIBRARY = WordEncoder(WORD), {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def test_decoding(texts):
    codec, library = byte_bpe(BYTE), Tokenizer.from_file(BYTE)
    encoded = library.encode_batch([*texts[:50], *ODD], add_special_tokens=False)
    ids = [*(e.ids for e in encoded), [220, 447], [247, 5], [50256]]
    found = codec.decode_batch(np.concatenate([np.array(i, np.int32) for i in ids]), np.array([len(i) for i in ids]))
    assert [f.decode() for f in found] == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_on_frames(documents, nasty, spark):
    rows = bpe_encode_decode(nasty, BYTE).collect()
    assert len(rows) == 7 and {r.decoded for r in rows if r.doc_id in (1, 2)} == {""}
    assert next(r for r in rows if r.doc_id == 5).decoded == "long words and more. " * 20000
    assert bpe_encode_decode(nasty.limit(0), BYTE).count() == 0
    assert all(r.decoded == (r.text or "") for r in bpe_encode_decode(documents, BYTE).join(documents, "doc_id").collect())


@pytest.mark.parametrize("slots", [1, 5, 16])
def test_shards(documents, slots):
    rows = shard_documents(documents, slots, range_rows=20).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    source = {r.doc_id: r.text or "" for r in documents.collect()}
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values()) and len(rows) == len(source)
    assert all(r.size == len(source[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id].encode()) for r in rows)
    sizes = [sum(x.size for x in by.get(k, [])) for k in range(slots)]
    assert max(sizes) - sum(sizes) / slots <= max(r.size for r in rows)


def test_shards_of_odd_rows(nasty, spark):
    rows = shard_documents(nasty, 4).collect()
    assert len(rows) == 7 and all(0 <= r.shard < 4 for r in rows)
    assert shard_documents(nasty.limit(0), 4).count() == 0
    hot = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'hot text', concat('t', id)) AS text")
    sizes = [r[1] for r in shard_documents(hot, 8).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * max(sizes)


def test_quality_statistics(texts, documents, nasty):
    found = {r.doc_id: r for r in judge_documents(documents, PRIOR, PRIOR_CHAIN).collect()}
    for row in documents.collect():
        t = row.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        seen, repeated = set(), 0
        for line in t.split("\n"):
            repeated += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
            seen.add(line)
        r = found[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.kept and r.base_failed)
    odd = judge_documents(nasty, PRIOR, PRIOR_CHAIN).collect()
    assert len(odd) == 7 and not any(r.kept for r in odd)
    assert keep_good(nasty, PRIOR, PRIOR_CHAIN).count() == 0 and keep_good(documents, PRIOR, PRIOR_CHAIN).columns == documents.columns


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    counts, chain = np.array([3, 0, 1, 5]), rng.normal(size=(2, 2))
    scores = rng.normal(size=9)
    found, at = viterbi(scores, counts, chain), 0
    for n in counts:
        def value(path, at=at):
            return sum(scores[at + i] * s for i, s in enumerate(path)) + sum(chain[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert value(found[at : at + n].tolist()) == pytest.approx(best)
        at += n


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights = train(docs, labels, sample_docs=2000)
    fitted = labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(2000)
    rows = judge_documents(docs, *weights).where("NOT base_failed").join(labels, "doc_id").join(fitted, "doc_id", "left_anti").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_without_labels(documents, spark):
    weights, _ = train(documents, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert weights is PRIOR


def brute_spans(t):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "AKIA", "akia", "ABCDEFGH12345678", "deadbeef" * 4, "0123456789abcdef", "a", "é", "日本", "\n", "x.y-z/"]), max_size=14), st.integers(0, 9))
def test_base_spans(parts, shift):
    t = "é" * shift + "".join(parts)
    assert [s for s in spans_of([t.encode(), b"deadbeef" * 3])[0] if s[1] in ("assign", "access", "hex")] == brute_spans(t)


def check_of(body):
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        out = chr(DIGITS[d]) + out
    return out.rjust(6, "0")


def test_checksums_and_redaction(spark, nasty):
    body = "abcdefghij" * 3
    good, wrong = f"ghp_{body}{check_of(body)}", f"ghp_{body}000000"
    assert spans_of([f"a {good} b".encode(), f"a {wrong} b".encode()]) == [[(2, "github", 2 + len(good))], []]
    df = spark.createDataFrame([(1, f"é token = {'ab' * 20}!", 50, "k"), (2, "clean", 5, "k"), (3, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    rows = {r.doc_id: r for r in redact_secrets(df).collect()}
    assert rows[1].text == "é [assign]!" and rows[1].n_chars == 11 and rows[2].text == "clean" and rows[3].text is None and rows[1].spans == "k"
    assert scan_secrets(nasty).count() == 7 and scan_secrets(nasty.limit(0)).count() == 0


def test_pages(spark):
    page = """<html><body><header><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies</p></div><main><article class="post"><header><h1>T &lt;i&gt;</h1></header><p>One <b>two</b>
     three</p><ul><li>a<li>b</ul><div class="comments"><p>Nice!</p></div><form><input><p>x</p></form><script>var a="</p><p>no</p>";</script><p>x<br>y<!-- c --> z&nbsp;q</article></main><aside>s</aside><footer>f</footer>"""
    assert main_text(Page(page), set()) == "T <i>\n\nOne two three\n\na\n\nb\n\nx y z q"
    assert main_text(Page("<div>" * 3000 + "deep" + "</div>" * 3000), set()) == "deep"
    pages = [(k, f"http://h.example/{k}", f"<body><nav>m {k}</nav><article><h1>t{k}</h1><p>Share this page</p><p>text {k} has words of its own</p><p>more {k} to say here</p></article></body>") for k in range(30)]
    odd = [(None, None, None), (100, "", ""), (101, "nonsense", "<p>alone</p>"), (101, "nonsense", "<p>alone</p>")]
    rows = extract_pages(spark.createDataFrame([(*p, "clash") for p in pages + odd], "page_id long, url string, html string, text string")).collect()
    found = {r.page_id: r.text for r in rows}
    assert found[7] == "t7\n\ntext 7 has words of its own\n\nmore 7 to say here" and found[None] == "" and found[100] == "" and found[101] == "alone" and len(rows) == 34
    copies = spark.createDataFrame([(k, f"http://c.example/{k}", "<article><h1>same</h1><p>all the same text</p></article>") for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extract_pages(copies).collect()} == {"same\n\nall the same text"}
    assert extract_pages(copies.limit(0)).count() == 0


def extracted(spark, htmls, host="h.example"):
    df = spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_pages(df).collect()}


def test_votes_decide_before_names(spark):
    long = [f"story {k} " + " ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    # the main text in a plain div, an article as a teaser; an unnamed constant line
    plain = extracted(spark, [f"<body><p>All rights are ours</p><div><p>{t}</p></div><article><p>teaser {k}</p></article><nav>m {k}</nav></body>" for k, t in enumerate(long)])
    assert plain[7] == f"{long[7]}\n\nteaser 7"
    # the region named as comments holds what varies
    named = extracted(spark, [f'<body><div class="comments"><p>{t}</p></div><footer>f {k}</footer></body>' for k, t in enumerate(long)])
    assert named[7] == long[7]
    # alone, names and an article that holds most decide
    assert extracted(spark, [f"<p>{long[0]}</p><article><p>teaser</p></article>"])[0] == f"{long[0]}\n\nteaser"
    assert main_text(Page("<ul><li><a>x</a><li><a>y</a></ul><p><a>a whole link</a></p>"), set()) == "a whole link"


def test_boilerplate_that_outweighs_the_article(spark):
    legal = "terms and conditions of this site in full " * 20
    found = extracted(spark, [f'<body class="postid-{k}"><div class="box c{k}"><p>{legal}</p></div><div class="t{k}"><p>short text {k}</p></div></body>' for k in range(30)])
    assert found[7] == "short text 7"


def test_layouts_and_small_hosts(spark):
    inner = ["<p>{b}</p><div><p>{t}</p></div>", "<section><p>{b}</p></section><p>{t}</p>", "<div><div><p>{b}</p></div></div><p>{t}</p>", "<main><p>{b}</p></main><section><p>{t}</p></section>"]
    found = extracted(spark, [f"<body>{form.format(b=f'boilerplate of layout {k}', t=f'text {k} {j}')}</body>" for k, form in enumerate(inner) for j in range(5)])
    assert [found[k] for k in range(20)] == [f"text {k} {j}" for k in range(4) for j in range(5)]
    # a block that few pages have, and a layout that only one has
    notice = "<blockquote><p>we were here first</p></blockquote>"
    htmls = [f"<body>{notice * (k % 5 == 0)}<p>text {k} a</p><p>text {k} b</p></body>" for k in range(30)] + [f"<body>{notice}<section><p>alone</p></section></body>"]
    found = extracted(spark, htmls)
    assert found == {k: f"text {k} a\n\ntext {k} b" for k in range(30)} | {30: "alone"}


def test_names_inside_an_article():
    inside = '<section id="related-work"><h2 id="how-to-share-code">share</h2><p>a</p></section><p class="comment">b</p><div id="search-results">c</div><div class="notice">d</div><div id="social-history">e</div>'
    assert main_text(Page(f'<article>{inside}<div class="comments">x</div><div class="a share-buttons">y</div></article>'), set()) == "share\n\na\n\nb\n\nc\n\nd\n\ne"
    assert main_text(Page('<div><h2 id="how-to-share-code">share</h2><p class="comment">b</p><section id="related-work">a</section></div><div class="ad-box">x</div>'), set()) == "share\n\nb\n\na"


@pytest.mark.parametrize("part", ["<a ", "<a b='", "<a \"'>", "<a '>' \">", "<!--", "<script>", "<div></p>", "<nav>", "<form><li></li>", "</", "<", "<a<a"])
def test_broken_markup_takes_linear_time(part):
    began = time.process_time()
    page = Page("start " + part * (120_000 // len(part)))
    assert page.leaves[0].text.startswith("start") and time.process_time() - began < 8


def test_tags_and_quotes():
    page = Page("<div class='a>b'>x</div><p title=\"un>y</p><!-- z --><b>w</b> 3 < 4 <!doctype> k <a href='q'>t</a><textarea><p>no</textarea>end<!--tail")
    assert [leaf.text for leaf in page.leaves] == ["x", "y", "w 3 < 4 k tend"]


def best_match(x, y):
    """The greatest weight of a matching of two forests, by trying all."""
    if not x or not y:
        return 0.0
    best = max(best_match(x[1:], y), best_match(x, y[1:]))
    (tag, key, children, _, kind), q = x[0], y[0]
    if tag == q[0]:
        own = 1.0 + best_match(children, q[2]) if children and q[2] else 1.0 + SAME_TEXT * (not children and key == q[1])
        best = max(best, own + SAME_CLASS * (kind == q[4]) + best_match(x[1:], y[1:]))
    return best


def forest(rng, depth):
    return [[rng.choice("ab"), (leaf := rng.random() < 0.5 or not depth) and rng.randrange(3) or None, [] if leaf else forest(rng, depth - 1), 0, rng.randrange(2)] for _ in range(rng.randrange(1, 4))]


def test_tree_matching_is_the_best(monkeypatch):
    rng = random.Random(3)
    for _ in range(150):
        x, y = forest(rng, 2), forest(rng, 2)
        assert match(["", None, x, -1, 0], ["", None, y, -1, 0], []) == 1.0 + best_match(x, y)
    # long lists are cut at texts that both have once
    monkeypatch.setattr(html_extract, "CELLS", 50)
    x = [["p", k, [], k, 0] for k in range(40)]
    pairs = []
    match(["", None, x, -1, 0], ["", None, [["p", -1, [], 90, 0], *x[5:30], *x[35:]], -1, 0], pairs)
    assert {(a, b) for a, b, same in pairs if same} == {(k, k) for k in (*range(5, 30), *range(35, 40))}


def test_long_lists_match_as_short_ones(monkeypatch):
    # rows of a table without its first one: no leaf of the table itself has a text
    x, y = (Page("<table>" + "".join(f"<tr><td>a{k}</td><td>b{k}</td></tr>" for k in range(first, 600)) + "</table>") for first in (0, 1))
    pairs = []
    match(x.root, y.root, pairs)
    assert {(x.leaves[a].text, y.leaves[b].text) for a, b, _ in pairs} == {(t, t) for k in range(1, 600) for t in (f"a{k}", f"b{k}")}
    assert all(same for *_, same in pairs)
    # one that moved
    x, y = (Page("".join(f"<p>{t}</p>" for t in texts)) for texts in ([*range(600), -1], [-1, *range(600)]))
    assert match(x.root, y.root, pairs := []) == 1.0 + 600 * (1.0 + SAME_TEXT + SAME_CLASS) and len(pairs) == 600
    # sizes from which tables are kept in part, rows are arrays and texts count as one bear on no result
    rng = random.Random(4)
    for _ in range(60):
        x, y = (["", None, [*forest(rng, 2), *forest(rng, 2), *forest(rng, 1)], -1, 0] for _ in range(2))
        found = []
        for cells, wide, scores, numbers in ((250_000, 64, 1_000_000, 200_000), (5, 64, 0, 0), (5, 2, 0, 200_000), (250_000, 2, 1_000_000, 0)):
            for name, value in (("CELLS", cells), ("WIDE", wide), ("SCORES", scores), ("NUMBERS", numbers)):
                monkeypatch.setattr(html_extract, name, value)
            found.append((match(x, y, pairs := []), pairs))
        assert all(f == found[0] for f in found) and found[0][0] == 1.0 + best_match(x[2], y[2])


def test_all_pages_against_their_articles(spark):
    """Of each page of the table, the text is blocks of the page, and those of the host's template aren't in it."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    rows = extract_pages(table).collect()
    assert len(rows) == len(html)
    for r in rows:
        blocks = [leaf.text for leaf in Page(html[r.page_id] or "").leaves]
        at = iter(blocks)
        assert all(any(b == own for own in at) for b in r.text.split("\n\n") if b)


def test_wavelet_files(documents, nasty, tmp_path):
    x = np.random.default_rng(1).integers(0, 300, 3000)
    file = WaveletFile(write_wavelet(x, np.array([1000, 2000]), [None, 5]))
    assert all(file.access(i) == x[i] for i in range(0, 3000, 7)) and file.doc_ids == [None, 5]
    assert all(file.rank(t, e) == (x[:e] == t).sum() for t in (0, 5, 299, 511, 4000) for e in (0, 1, 511, 512, 513, 2999, 3000))
    assert all(file.select(t, n) == np.flatnonzero(x == t)[n] for t in (0, 7, 299) for n in range((x == t).sum()))
    assert (file.tokens() == x).all()
    for error in (lambda: file.access(3000), lambda: file.select(7, 10**6), lambda: WaveletFile(b"no")):
        with pytest.raises((IndexError, ValueError)):
            error()
    for df, k in ((documents, 100_000), (nasty, 1000)):
        shards, uri = write_token_files(df, WORD, 2, f"file://{tmp_path}/{k}", shard_bytes=k)
        rows = sorted(read_token_files(shards, uri).collect(), key=lambda r: r.start)
        library, source = Tokenizer.from_file(WORD), collections.defaultdict(list)
        for r in df.collect():
            source[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
        assert len(rows) == df.count() and [(r.doc_id is not None, r.doc_id or 0) for r in rows] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
        at = 0
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert r.start == at and ids in source[r.doc_id]
            at += len(ids)
    shards, uri = write_token_files(nasty.limit(0), WORD, 2, f"file://{tmp_path}/none")
    assert read_token_files(shards, uri).count() == 0


def test_digest_form():
    assert hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
