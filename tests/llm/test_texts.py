"""Operators on single texts against brute force: winnowing, token counts, BPE, substring dedup."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from phylospark.llm import bpe, common, mincut, substring, tokens, winnow

BYTES, LOWER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(common.WORD)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_winnowing_selects_rightmost_minima():
    pick = random.Random(3)
    for n in (*range(0, 60), 200, 1000):
        text = "".join(pick.choice("abé日") for _ in range(n))
        points = winnow.points_of(text)
        own = winnow.Fingerprint(points)
        hashes = common.window_hashes(points, min(winnow.K, n)) if n else []
        keys = [int(h) >> 24 for h in hashes]
        w = min(winnow.WINDOW, len(keys))
        chosen = sorted({max(range(i, i + w), key=lambda p, k=keys: (-k[p], p)) for i in range(len(keys) - w + 1)}) if n else []
        assert own.at.tolist() == chosen and own.likeness(own) == 1.0


def test_winnowing_in_stretches(monkeypatch):
    pick = random.Random(8)
    points = winnow.points_of("".join(pick.choice("ab") for _ in range(500)))
    whole = winnow.Fingerprint(points)
    for stretch in (1, 7, 100, 465):
        monkeypatch.setattr(winnow, "STRETCH", stretch)
        parted = winnow.Fingerprint(points)
        assert parted.at.tolist() == whole.at.tolist() and parted.hashes.tolist() == whole.hashes.tolist()


def test_winnowing_order_of_null_and_repeated_ids(spark):
    """Each row's edited text is made with its follower's: ids descending, nulls last, then hashes descending."""
    rows = [(i % 7 if i % 3 else None, f"text {i % 40} " + "xyz" * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tied = sorted(docs.selectExpr("doc_id", "text", "xxhash64(text) AS t").collect(), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    expected = Counter()
    for r, after in zip(tied, [*tied[1:], tied[0]], strict=True):
        n = len(r[1])
        expected[r[0], n, hashlib.sha256((r[1][: n - n // 3] + after[1][: n // 3]).encode()).hexdigest()] += 1
    found = winnow.compare_with_edits(docs.repartition(5)).select("doc_id", "n_chars", "edited_sha256")
    assert bag(found.collect()) == expected


def test_winnowing_guarantee():
    pick = random.Random(4)
    shared = "".join(pick.choice("abcdefgh ") for _ in range(winnow.K + winnow.WINDOW - 1))
    a, b = (winnow.Fingerprint(winnow.points_of(x * 50 + shared + y * 50)) for x, y in (("xy", "zw"), ("pqr", "st")))
    assert set(a.hashes.tolist()) & set(b.hashes.tolist())


def test_winnowing_text_keeps_whole_positions():
    own = winnow.Fingerprint(winnow.points_of("some words, and then some more words " * 3))
    own.at = own.at + np.uint32(1 << 24)
    text = own.text()
    cut = [text[i : i + 18] for i in range(0, len(text), 18)]
    assert [(int(x[:10], 16), int(x[10:], 16)) for x in cut] == list(zip(own.hashes.tolist(), own.at.tolist(), strict=True))
    assert min(own.at) >= 1 << 24 and winnow.Fingerprint(winnow.points_of("")).text() == ""


def test_winnowing_query(docs, none, rows):
    found = winnow.compare_with_edits(docs).collect()
    tie = {r["text"]: r["h"] for r in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    expected = Counter()
    for i, (doc_id, text) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        own, other, following = (winnow.Fingerprint(winnow.points_of(t)) for t in (text, edited, after))
        expected[doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own.text(), other.text(), own.likeness(other), own.likeness(following)] += 1
    assert bag(found) == expected
    assert winnow.compare_with_edits(none).count() == 0
    one = winnow.compare_with_edits(docs.where("doc_id = 16")).first()
    assert one["near_next"] == 1.0
    prints = winnow.fingerprints(docs.where("doc_id IN (1, 3)")).orderBy("doc_id").collect()
    assert prints[0]["hashes"] == [] and prints[1]["positions"] == [0]


def test_merge_matches_quadratic():
    ranks = bpe.read_ranks(BYTES)

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    pick = random.Random(2)
    pieces = [bytes(pick.randrange(256) for _ in range(n)) for n in range(1, 40)] + ["".join(pick.choice("abcaab") for _ in range(n)).encode() for n in range(1, 90)]
    for piece in [*pieces, "Überraschungseffekte".encode(), b"a" * 100]:
        assert bpe.merge(piece, ranks) == (slow(piece) if piece not in ranks else [ranks[piece]])


def test_bpe_query(docs, none, rows):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    found = bpe.digest(bpe.encode_decode(docs, BYTES, public_tokenizers.PATTERN)).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        expected[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert bag(found) == expected
    assert bpe.encode_decode(none, BYTES, public_tokenizers.PATTERN).count() == 0


def test_remembered_stays_bounded():
    kept = bpe.Remembered(len, most=3, longest=4)
    assert [kept[k] for k in ("a", "bb", "ccc", "dddd", "eeeee", "a")] == [1, 2, 3, 4, 5, 1]
    assert len(kept) <= 3 and len(kept.old) <= 3 and "eeeee" not in kept


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(LOWER)
    found = tokens.count(docs, LOWER).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 2048] += 1
    assert bag(found) == expected
    assert tokens.count(none, LOWER).count() == 0
    proven = tokens.prove(LOWER)
    counter = tokens.Counter(LOWER, proven)
    for token in sorted(proven)[::997]:
        assert len(counter.merger.symbols(token)) == 1
    pick = random.Random(1)
    for _ in range(3000):
        text = "".join(pick.choice(["<|endoftext|>", "'RE", "İ", "ΑΣ", "\x85", "ﬁ", "日本", "1", " ", "\xa0", chr(pick.randrange(32, 0x2FFF))]) for _ in range(pick.randrange(10)))
        assert counter(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text


def brute_cut(rows, window):
    split = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, rows, batches):
    assert bag(substring.remove_repeats(docs, batches=batches).collect()) == brute_cut(rows, 35)


@pytest.mark.parametrize("part", [1, 2])
def test_substring_hot_windows_are_dealt_out(docs, rows, part):
    assert bag(substring.remove_repeats(docs, part=part).collect()) == brute_cut(rows, 35)


def test_substring_edges(docs, none):
    assert substring.remove_repeats(none).count() == 0
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes and cut.count() == docs.count()
    assert cut.where("doc_id = 9").first()["text"] == docs.where("doc_id = 9").first()["text"] or cut.where("doc_id = 9").first()["n_chars"] < docs.where("doc_id = 9").first()["n_chars"]


def test_index_compacts_and_marks(spark, docs):
    index = substring.FingerprintIndex(spark, fanout=2)
    for part in docs.randomSplit([1.0, 1.0, 1.0], 3):
        index.append(part)
        assert len(index.runs) < 2 or len(index.runs) == 1
    whole = substring.FingerprintIndex(spark)
    whole.append(docs)
    assert bag(index.repeated().select("h", "n").collect()) == bag(whole.repeated().select("h", "n").collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<article><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with <b>bold</b> words,<br>and more.<p>Second &lt;one&gt;.<p>Yes.</article>
<aside>Related things to read today.</aside><div id="comments"><p>Nice text, thank you very much for it.</p></div><form><label>Mail</label></form>
<footer>&copy; 2020 &middot; Imprint</footer></body></html>"""


def test_html():
    assert mincut.main_text(PAGE) == "A title & more\nFirst paragraph with bold words, and more.\nSecond <one>.\nYes."
    assert mincut.main_text("") == "" and mincut.main_text("<div><p") == ""
    assert mincut.main_text(PAGE[: PAGE.index("Second")]).startswith("A title & more\nFirst")
    plain = "<body><ul class=menu><li><a href=x>One</a></ul><div><p>" + "A long sentence about something. " * 8 + "<p>Short one.<p>" + "Another long sentence follows here. " * 8 + "</div></body>"
    assert len(mincut.main_text(plain).split("\n")) == 3 and "One\n" not in mincut.main_text(plain)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><p title=it's>One sentence stands here.<p>Two don't end.<p>Three.</article>", "One sentence stands here.\nTwo don't end.\nThree."),
        ('<article><p title="foo>Broken, but a text.</p><p class="x">Two is here.</p></article>', "Broken, but a text.\nTwo is here."),
        ("<article><p title=\"a > b\" data-x='<b>' hidden2>One is here.</p></article>", "One is here."),
        ('<article class="post has-sidebar search-result"><p>One is here.</p></article>', "One is here."),
        ('<main class="with-sidebar"><div class="no-sidebar"><p>One is here.</p></div><div class="sidebar"><p>Two is not.</p></div></main>', "One is here."),
        ('<main><p>One is here.</p><section id="comments"><article class="comment"><p>Nice text, thank you.</p></article></section></main>', "One is here."),
        ("<article><p>One<!-- no > no -->two</p><!--><p>Three.</p><!-- open <p>lost</p></article>", "Onetwo\nThree."),
        ("<article>a < b and c &lt; d</span></div> e<p>f.</article>", "a < b and c < d e\nf."),
    ],
)
def test_html_that_is_odd(page, expected):
    assert mincut.main_text(page) == expected


def test_html_classifier_on_held_out_pages():
    from phylospark.llm import pagemaker

    right = missed = extra = 0
    for page, wanted in pagemaker.pages(150, 99):
        found = set(mincut.main_text(page).split("\n"))
        right, missed, extra = right + len(found & wanted), missed + len(wanted - found), extra + len(found - wanted)
    assert right > 900 and missed <= 0.01 * right and extra <= 0.01 * right


def test_long_pages_take_linear_time():
    import time

    rows = "".join(f"<div><p>{'word ' * (i * 7 % 23)}x{i}</p></div><p><a href=x>l{i} {'b ' * (i * 5 % 11)}</a>" for i in range(10_000))
    began = time.perf_counter()
    assert "x1" in mincut.main_text(f"<body>{rows}</body>")
    assert "x" in mincut.main_text("<article>" + "<div>" * 8000 + "x</span></b>" * 8000)
    mincut.main_text("<article><p title='" * 3000 + "x")
    assert time.perf_counter() - began < 15


def test_min_cut_is_minimal():
    pick = random.Random(7)
    for _ in range(40):
        n = pick.randrange(1, 7)
        terminal = [pick.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, pick.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if pick.random() < 0.5]

        def cost(side, terminal=terminal, edges=edges):
            return sum(t for t, s in zip(terminal, side, strict=True) if t > 0 and not s) - sum(t for t, s in zip(terminal, side, strict=True) if t < 0 and s) + sum(x for a, b, x in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mincut.min_cut(terminal, edges)) == pytest.approx(best)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    found = mincut.extract(pages).collect()
    assert len(found) == 4 and all(r["n_chars"] == len(r["text"]) for r in found) and sum(r["text"] == "" for r in found) == 2
    assert mincut.extract(pages.limit(0)).count() == 0
