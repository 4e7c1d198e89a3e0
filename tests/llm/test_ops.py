"""The ten operators against brute force, round trips and held-out labels, with nulls, ties, empties and repeats."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from kmerloom.llm import chat, decontaminate, fingerprint, html_extract, lm_score, ngram_join, packing, pii, simple8b, tokens, toxicity  # noqa: E402

WORDS = "the of and in to alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def texts() -> list[tuple]:
    rng = random.Random(1)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    out += [(100, None), (101, ""), (102, "   \n\t "), (103, out[3][1]), (104, out[3][1]), (105, "one"), (106, "two words"), (107, "é　x\x1cy  z\n\n\nq Σ İ"), (107, out[5][1]), (108, prose(rng, 5000)), (None, out[7][1]), (109, out[8][1] + " extra")]
    return out + [out[9]]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators use themselves
    rows = [(i, t, "en", 1, 2, "x") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node long, bucket int, kind string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ids_of(name: str, text: str | None, end: int) -> list[int]:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1 -----------------------------------------------------------------------------------------------------------


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 239, 240, 4096, 4097, 20000):
        for high in (1, 2, 300, 70000, 2**62):
            x = r.integers(0, high, n, dtype=np.uint64)
            x[: n // 7] = 2**64 - 1 if high > 2**60 else 0
            b = simple8b.encode(x)
            assert (simple8b.decode(b) == x).all()
            assert (simple8b.decode(b, 1, 3) == x[4096 : 3 * 4096]).all()


@pytest.mark.parametrize("kind, name", [(tokens.ByteTokens, "byte_bpe_50k.json"), (tokens.WordTokens, "word_bpe_49k.json")])
def test_tokens_of_odd_texts_equal_the_library(kind, name):
    rng, mine, library = random.Random(5), kind(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    odd = "a|the|THE| |  |\n|\n\n|\t|\u00a0|\u2003|\u3000|.|,|'s|don't|\u03a3|\u0391\u03a3|\u03a3\u0130|\u0130|\u00df|e\u0301|\u4e2d|\U0001f600|1|42|\ufb01|\u0345|\u0386|\u01c5|\r\n|\u212a|\u1100\u1161\u11a8|\x1c|\x85".split("|") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz\u00e4ABC") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    rows = ["".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice(words) + rng.choice([" ", "", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    got = [x.tolist() for at in range(0, len(rows), 500) for x in mine.ids_of(rows[at : at + 500])]
    assert got == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


@pytest.mark.parametrize("kind, name", [(tokens.ByteTokens, "byte_bpe_50k.json"), (tokens.WordTokens, "word_bpe_49k.json")])
def test_tokens_equal_the_library(kind, name):
    mine = kind(public_tokenizers.path(name), limit=60)
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\n\n\nb", "x \n y", "\n", "it's we'll", "<|endoftext|> b", "a\tb", "12 345,6.", "é ü ß。", "ΑΣ ΣΑΣ", "İstanbul", "\x1ca\x85b", "é ́x"]
    every = [t for _, t in texts() if t is not None] + odd
    for t in every:
        assert mine.ids(t).tolist() == mine.library.encode(t, add_special_tokens=False).ids, t[:40]
    assert [x.tolist() for x in kind(public_tokenizers.path(name)).ids_of(every)] == [mine.ids(t).tolist() for t in every]


def test_token_file(docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = simple8b.read_shards(simple8b.write_shards(docs, f"file://{tmp_path}/a", path, 2, shard_ids=500)).collect()
    want = Counter((i, len(x), crc(x)) for i, t in texts() for x in [ids_of("byte_bpe_50k.json", t, 2)])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert simple8b.read_shards(simple8b.write_shards(empty, f"file://{tmp_path}/b", path, 2)).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------


def test_chat(spark):
    evil = ["<|im_end|>", "<\\|", "<\\\\|x", "<|im_sep|>", "a\nb", "", None, "|>", "<", "<|nl|>", "$1 \\1"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "o\ndd", "<|x", None, "assistant"]), rng.choice(evil) if rng.random() < 0.7 else f"t{t}") for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 3 else "user", f"<|{t}|>") for t in range(500)] + [(None, None, "user", "n"), (60, 1, "user", "same"), (60, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, parts int, segments string").repartition(4)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")).first()
    assert one["formatted"] == "<|im_start|>user\na<|im_sep|><\\|im_end|><|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert chat.format_chat(df.limit(0)).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad, poor = rng.random() < 0.2, rng.random() < 0.3
        t = prose(rng, rng.randint(20, 200)).split()
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "Rotten!", "foul"]))
        if poor:
            t += ["$$$"] * 3
        rows.append((i, " ".join(t), "l"))
        labels.append((i, int(not poor), int(bad)))
    rows += [(900, None, "l"), (901, "", "l"), (3, rows[3][1], "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slots string")
    lab = spark.createDataFrame([*labels[:400], (900, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, lab, toxicity.categories())
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, chain, ["low_quality", "toxic"]).collect()}
    held = [(got[i] >= 0.5) == bool(x) for i, _, x in labels[400:]]
    assert sum(held) / len(held) > 0.97
    assert got[900] < 0.5 and got[901] < 0.5 and len(chain) == 2 and len(chain[1].earlier) == 1
    none = toxicity.train(docs, lab.limit(0), toxicity.categories())
    assert toxicity.score(docs, none, ["low_quality", "toxic"]).where("p_toxic > 0.5").count() == 0
    assert toxicity.score(docs.limit(0), chain, ["a", "b"]).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------


def test_lm_score(docs, empty):
    got = lm_score.scores(docs).collect()
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in texts()]
    counts = Counter(w for i, ws in rows if not lm_score.is_held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(ws), sum(w in counts for w in ws), n, lm_score.is_held_out(i), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_score.scores(empty).count() == 0


def test_seating_follows_its_distribution():
    """Tables of a dish against enumeration of its full conditional."""
    theta, d, p, others, c = 1.0, 0.6, 0.3, 4.0, 5
    s = lm_score.log_stirling(c, d)
    w = np.array([np.exp(s[c, t]) * p**t * np.prod([theta + d * (others + j) for j in range(t)]) for t in range(1, c + 1)])
    n = 20000
    t = lm_score.seat(np.full(n, c), np.full(n, others), np.full(n, p), theta, d, np.random.default_rng(0))
    assert np.abs(np.bincount(t.astype(int), minlength=c + 1)[1:] / n - w / w.sum()).max() < 0.02
    many = lm_score.seat(np.full(50, 5000), np.full(50, 10.0), np.full(50, 0.05), theta, d, np.random.default_rng(1))
    assert (many >= 1).all() and (many < 500).all()


def test_context_probabilities_sum_to_one():
    """In one part, a context's masses and its share for the parent are a distribution."""
    chunk = lm_score.Chunk(0, [1], np.array([False]), np.array([9]), np.array([1, 2, 1, 2, 1, 3, 1, 2, 0], dtype=np.int32), np.arange(4, dtype=np.uint64) * np.uint64(7919) + np.uint64(1))
    p = lm_score.pairs_of(chunk, 1, {})
    assert p.count.sum() == 9 and len(p.u) == len(set(zip(p.u.tolist(), p.w.tolist())))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_contexts_are_seated_with_shares_of_all_parts(parts, monkeypatch):
    """The parent's probability of a word is its share of all contexts' words, whatever the number of parts."""
    rng = random.Random(6)
    vocab = np.random.default_rng(6).integers(1, 1 << 63, 80).astype(np.uint64)
    sent, cells = [], set()
    for number in range(2):
        tokens = np.array([min(rng.randrange(80), rng.randrange(80)) for _ in range(2000)], dtype=np.int32)
        chunk = lm_score.Chunk(number, [1, 2], np.array([False, True]), np.array([1500, 500]), tokens, vocab)
        hot = {int(vocab[0] & lm_score.LOW48): min(parts, 4)}
        u, w = chunk.contexts()[:1500], tokens[:1500]
        cells |= set(zip(u.tolist(), w.tolist()))
        p, key = lm_score.pairs_of(chunk, parts, hot), vocab & lm_score.LOW48
        for part, own, first in lm_score._slices(p, chunk):
            runs = np.diff(np.r_[first, own.stop - own.start])
            sent.append((part, number, lm_score._pack(lm_score._six(key[p.u[own][first]]), lm_score._z(runs, "<u4"), lm_score._six(key[p.w[own]]), lm_score._z(p.count[own], "<u4"))))
    table = lambda rows, schema: pa.Table.from_batches([lm_score.common.arrow(schema, list(zip(*rows)))])
    told = pa.concat_tables([lm_score.tell_words(table([s for s in sent if s[0] == i], lm_score._SENT), parts) for i in sorted({s[0] for s in sent})]).to_pylist()
    assert sum(r["c"] for r in told) == len(cells) * parts
    answers = [tuple(r.values()) for i in sorted({r["part"] for r in told}) for r in lm_score.answer_words(table([tuple(r.values()) for r in told if r["part"] == i], lm_score._TOLD)).to_pylist()]
    used = []
    monkeypatch.setattr(lm_score, "SWEEPS", 4)
    monkeypatch.setattr(lm_score, "seat", lambda c, others, p, *_: used.append(p) or np.ones(len(c)))
    for i in sorted({s[0] for s in sent}):
        lm_score.seat_pairs(table([x for x in sent if x[0] == i], lm_score._SENT), table([x for x in answers if x[0] == i], lm_score._TOLD), parts, hot)
    share = Counter(w for _, w in cells)
    got = np.unique(np.round(np.concatenate(used), 12))
    assert len(got) and set(got) <= {round(c / len(cells), 12) for c in share.values()}


# 5 -----------------------------------------------------------------------------------------------------------


def base_spans(x: str) -> str:
    def luhn(d):
        return sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(d[::-1])) % 10 == 0

    sp = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    sp += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            sp.append((m.start(), 2, m.end()))
    sp += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(sp))


def test_pii_base_by_regular_expressions():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.y%z@", "1.2.3.4", "256.1.1.1.1", "+1 (377) 555-0271", "4111 1111 1111 1111", "4111111111111111", "-", " ", ".", "..", "+", "++1", "9", "12", "é", "@@b.co", "a@b", ".1", "0000000000000000", "5-5"]
    for _ in range(4000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert pii.shown([s for s in pii.find(x) if s[1] < 4]) == base_spans(x), repr(x)


def test_pii_added_kinds_and_tables(docs, empty):
    t = "IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678, see https://u:p@h.org/x?y=1."
    kinds = [pii.KINDS[k] for _, k, _ in pii.find(t)]
    assert kinds.count("account") == 2 and "address" in kinds
    assert pii.redact("write to a.b@c.de now") == "write to [EMAIL] now" and pii.redact(None) is None
    assert pii.scan(docs).count() == len(texts()) and pii.scan(empty).count() == 0
    assert pii.redacted(docs).columns == docs.columns


# 6 -----------------------------------------------------------------------------------------------------------


def weighted(a: list, b: list) -> float:
    a, b = Counter(a), Counter(b)
    low = sum((a & b).values())
    return low / (sum((a | b).values()))


def shingles(w: list, n: int = 5) -> list:
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def test_decontamination_by_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "...")]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(0, 90)).split()
        if i % 3 == 0:
            own = (rng.choice(items[:25])[1]).split()
            if i % 2 and len(own) > 30:
                own[0] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else ", ".join(w)))
    rows += [(200, None), (201, ""), rows[0]]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*r, "u") for r in items], "item_id long, text string, doc_id string")
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontaminate.find(docs, bench).collect())
    want: Counter = Counter()
    for d, t in rows:
        w = decontaminate.words_of(t)
        for i, x in items:
            own = decontaminate.words_of(x)
            if not own or not w:
                continue
            n = min(5, len(own))
            size = min(len(own), len(w))
            best = max((weighted(shingles(w[a : a + size], n), shingles(own, n)) for a in range(len(w) - size + 1)), default=0) if len(w) >= n else 0
            if best >= 0.8:
                want[d, i, round(best, 9)] += 1
    assert got == want and sum(got.values()) >= 20
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_radius():
    r = np.random.default_rng(1)
    items = decontaminate.Items([(i, prose(random.Random(i), 20 + i % 2)) for i in range(50)])
    prints = []
    for x in items.prints:
        for far in range(0, 30, 3):
            y = int(x)
            for b in r.choice(64, far, replace=False):
                y ^= 1 << int(b)
            prints.append(y)
    prints = np.array(prints, dtype=np.uint64)
    near = decontaminate.popcount(prints[:, None] ^ items.prints) <= items.radius
    for group in set(items.groups.values()):
        windows, found = items.candidates(group, prints)
        assert set(zip(windows.tolist(), found.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near & (items.group == group)))))
    random_prints = r.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 20_000, dtype=np.uint64)
    one = decontaminate.Items([(0, prose(random.Random(0), 20))])
    first = [f for f, _ in one.buckets]
    met = sum(f[one.block(random_prints, b).astype(np.int64) + 1] - f[one.block(random_prints, b).astype(np.int64)] for b, f in enumerate(first))
    assert met.mean() < 0.06  # the look-up itself leaves out most windows


def test_decontamination_recall_of_edited_items():
    """Windows with a similarity of 0.8 or more are found in 0.9 of the cases at least, equal ones always."""
    rng = random.Random(8)
    found = wanted = 0
    for i in range(400):
        own = [f"{w}{rng.randrange(50)}" for w in prose(rng, rng.randint(40, 120)).split()]
        w = list(own)
        for at in rng.sample(range(len(w)), rng.randint(0, max(1, len(w) // 45))):
            w[at] = "changed"
        text, item = " ".join(w), " ".join(own)
        similar = weighted(shingles(w, 5), shingles(own, 5))
        if similar >= 0.8:
            wanted += 1
            found += bool(decontaminate.find_in(decontaminate.common.hashed_words(decontaminate.words_of(text), decontaminate.common.WordHashes()), decontaminate.Items([(1, item)])))
        if similar == 1:
            wanted, found = wanted - 1, found - 1
    assert wanted > 150 and found >= 0.9 * wanted


def test_items_of_one_id_or_none_stand_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 40)
    rng = random.Random(9)
    texts_ = [prose(rng, 12) for _ in range(300)]
    items = [(None, texts_[0]), (None, texts_[1]), (1, texts_[0]), (1, texts_[0]), *((i, t) for i, t in enumerate(texts_[2:], 5))]
    docs = spark.createDataFrame([(1, f"{texts_[0]} so {texts_[1]}"), (2, texts_[250]), (None, texts_[1])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == {(1, None): 2, (1, 1): 2, (2, 253): 1, (None, None): 1}


# 7 -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, and more cookies, on this site.</div>{body}
<aside><p>Aside, with, many, commas, and a lot of text that is no article at all.</p></aside><section id="comments"><p>A reader says, at length, that this, that and the other, is so.</p></section>
<form><input value="x"><button>Send</button></form><footer>&copy; 2020, all, rights</footer></body></html>"""
BODY = "<h1>Head &amp; shoulders</h1><p>First para, with <b>bold</b>,\n commas and text &lt;x&gt;.<p>Second <i>one<p>Third, after an open tag.</p><ul><li>item one<li>item two</ul><pre>pre  text</pre>"
TEXT = "Head & shoulders First para, with bold, commas and text <x>. Second one Third, after an open tag. item one item two pre text"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div id='content'>{}</div>", "<main><div class=post-body>{}</div></main>", "<div class='page'><div class='entry-content'>{}</div></div>", "<div><div class='sidebar'><p>No, no, no, never, ever.</p></div><article><header>{}</header></article></div>"])
def test_html(wrap):
    assert html_extract.extract(PAGE.format(body=wrap.format(BODY))) == TEXT


def test_html_edges(spark):
    assert html_extract.extract(None) == "" and html_extract.extract("") == "" and html_extract.extract("<p></p>") == ""
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<div>" * 3000 + "deep, text" + "</div>" * 10) == "deep, text"
    df = spark.createDataFrame([(1, "u", None, 2), (2, None, "<p>a&nbsp;b</p>", 3), (None, "u", "", 4)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()) == [(0, "", 0), (1, "", 0), (2, "a b", 3)]


# 8 -----------------------------------------------------------------------------------------------------------


def test_packing(docs, empty):
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    seqs, pieces = {}, Counter()
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    total = 0
    for i, t in texts():
        ids = ids_of("word_bpe_49k.json", t, 1)
        total += len(ids)
        at = 0
        while at < len(ids):  # walk the document through pieces that hold its ids
            step = next(k for k in pieces if pieces[k] and k[0] == i and k[1] == at and k[4] == len(ids) and k[3] == crc(ids[at : at + k[2]]))
            pieces[step] -= 1
            at += step[2]
        assert at == len(ids)
    assert not +pieces and total == sum(r["length"] for r in got)
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_bm25_scores():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 50, rng.integers(1, 40)).astype("<u2") for _ in range(30)]
    idf = rng.random(1 << 16)
    index = packing.Index(pieces, idf, 20.0)
    for seed in range(30):
        want = []
        for p in pieces:
            tf = Counter(p.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(p) / 20.0)) for t in set(pieces[seed].tolist()) if t in tf))
        assert np.allclose(index.scores(seed), want)


# 9 -----------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, empty, spark):
    got = fingerprint.fingerprints(docs).collect()
    rows = sorted(((i, t or "") for i, t in texts()), key=lambda x: (-1 if x[0] is None else x[0], x[1].encode()))
    want = Counter()
    for j, (i, t) in enumerate(rows):
        e = fingerprint.edited(t, rows[(j + 1) % len(rows)][1])
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {r["doc_id"]: r["fingerprint"] for r in got}
    assert same[3] == same[103] == same[104]
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_sketch_estimates():
    rng = random.Random(9)
    h = fingerprint.common.WordHashes()
    a, b = prose(rng, 3000), prose(rng, 3000)
    both = a + " " + b
    sa, sb, sc = (fingerprint.sketch(x, h) for x in (a, b, both))
    sets = [set(shingles(x.split())) for x in (a, b, both)]
    assert abs(fingerprint.resemblance(sa, sc) - len(sets[0] & sets[2]) / len(sets[0] | sets[2])) < 0.15
    assert fingerprint.containment(sa, sc) > 0.85
    assert abs(fingerprint.distinct_count(sc) / len(sets[2]) - 1) < 0.3
    assert len(np.setdiff1d(fingerprint.merge(sa, sb)[:100], sc)) <= 1
    assert (fingerprint.from_text(fingerprint.as_text(sa)) == sa).all()


# 10 ----------------------------------------------------------------------------------------------------------


def groups_by_brute_force(rows, n, percent):
    sets = [set(shingles(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), n)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_groups(spark, n, percent):
    rng = random.Random(n)
    rows = texts()[:-2]
    common = prose(rng, 30)
    for i in range(200, 260):
        w = rows[rng.randrange(30)][1].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w) + (" " + common if i % 4 == 0 else "")))
    base = prose(rng, 150).split()
    for i in range(300, 340):  # near copies of one text, some at the edge of the threshold
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = ngram_join.near_groups(docs, n, percent)
    assert Counter(map(tuple, got.collect())) == groups_by_brute_force(rows, n, percent)
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs, n, percent).collect()}
    ids = {}
    for (d, _, c), _k in groups_by_brute_force(rows, n, percent).items():
        ids[d] = ids.get(d, False) or d == c or d is None
    assert kept == {d for d, stays in ids.items() if stays}


def test_groups_of_nothing(empty):
    assert ngram_join.near_groups(empty).count() == 0


# pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows, labels = [], []
    for i in range(120):
        t = prose(rng, 60)
        if i % 6 == 0:
            t += " vile foul vile"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    item = prose(rng, 25)
    rows += [(500, rows[1][1], "en", "s", 1), (501, rows[2][1] + " more", "en", "s", 1), (502, prose(rng, 20) + " " + item, "en", "s", 1), (503, prose(rng, 30) + " a.b@c.de " + prose(rng, 9), "en", "s", 1), (504, None, "en", "s", 0), (505, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert docs.columns == cols
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in range(120) if i % 6}
    assert set(seen["toxicity"]) == clean | set(range(500, 506))
    assert set(seen["ngram_join"]) == set(seen["toxicity"]) - {500, 501}
    assert set(seen["decontamination"]) == set(seen["ngram_join"]) - {502}
    assert "[EMAIL]" in seen["pii"][503] and seen["pii"][504] is None
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(seen["pii"])


def test_registry_has_all():
    from kmerloom.llm import registry

    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and json.dumps(registry.ORACLE_SQL)
    assert F is not None
