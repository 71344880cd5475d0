"""The training-data operators against brute force, round trips and held-out rows, with the awkward cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factmill.llm import ann, chat, decontaminate, jaccard, lines, lmscore, packing, substrings, tokencounts, toxicity
from factmill.llm import textarrays as ta
from factmill.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits int, id int, rows string, chunk int"
COLUMNS = ["text", "lang", "source", "n_chars", "hits", "id", "rows", "chunk"]


def documents(spark, texts, ids=None):
    """A documents table with extra columns of clashing names."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, 1, 2, "r", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sample(n=60, seed=3):
    """Texts with copies, near copies, shared passages, nulls, empties, ties and a long one."""
    r = random.Random(seed)
    vocab = ["ä" + str(k) if k % 17 == 0 else "w" + str(k) for k in range(400)]
    make = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = make(40)
    texts = [make(r.randint(1, 120)) for _ in range(n)]
    texts[5] = texts[2]
    texts[9] = None
    texts[10] = ""
    texts[11] = " \n\t "
    texts[12] = texts[13] = make(3)
    for k in (15, 16, 17, 40):
        texts[k] = make(10) + " " + shared + " " + make(5)
    words = make(100).split(" ")
    for k in range(20, 30):
        w = list(words)
        for _ in range(k - 20):
            w[r.randrange(100)] = "x" + str(r.randrange(1000))
        texts[k] = " ".join(w)
    texts[31] = "a" * 300
    texts[32] = "b" + "a" * 200
    texts[33] = make(3000)
    texts[34] = "\x00\x1f odd <|im_end|> ÀÉ’"
    return texts


TEXTS = sample()


def test_rolling_hash_depends_on_content_only():
    raw = np.frombuffer(b"abcdefabcdef", np.uint8)
    h = ta.rolling_hash(raw, 4)
    assert h[0] == h[6] and len(set(h.tolist())) == 6
    sums = ta.prefix_hash(raw)
    assert ta.stretch_hash(sums, np.array([0]), np.array([6])) == ta.stretch_hash(sums, np.array([6]), np.array([12]))


def test_flat_and_blocks():
    raw, offsets = ta.flat(pa.array(["ab", None, "", "c"])[1:])
    assert raw.tobytes() == b"c" and offsets.tolist() == [0, 0, 0, 1]
    assert list(ta.blocks(np.array([0, 5, 6, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    start, end, row = ta.runs(np.array([1, 1, 1, 0, 1], bool), np.array([0, 2, 2, 5]))
    assert (start.tolist(), end.tolist(), row.tolist()) == ([0, 2, 4], [2, 3, 5], [0, 2, 2])


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_lm_score(spark):
    texts = ["the cat sat", "the dog sat on the mat", None, "", "The Cat", "qq zz"]
    docs = documents(spark, texts)
    models = lmscore.train(docs, spark.createDataFrame([(0,), (4,), (None,), (99,)], "doc_id long"))
    got = {r["doc_id"]: r for r in lmscore.score_documents(docs, models).collect()}
    ids = lambda t: lmscore.tokens(*ta.flat(pa.array([t])))[0].tolist()
    pairs, words, total = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [0, 0]
    for d, t in enumerate(texts):
        for k in (0, 1) if d in (0, 4) else (1,):
            before = -1
            seq = ids(t)
            words[k][-1] += bool(seq)
            for w in seq:
                pairs[k][before, w] += 1
                words[k][w] += 1
                total[k] += 1
                before = w
    for d, t in enumerate(texts):
        seq = ids(t)
        assert got[d]["n_tokens"] == len(seq)
        if not seq:
            assert got[d]["score"] is None
            continue
        loss = [0.0, 0.0]
        for k in (0, 1):
            before = -1
            for w in seq:
                seen = pairs[k][before, w] / max(words[k][before], 1)
                loss[k] -= math.log(lmscore.MIX * seen + (1 - lmscore.MIX) * (words[k][w] + 1) / (total[k] + lmscore.VOCABULARY))
                before = w
        assert got[d]["target_loss"] == pytest.approx(loss[0] / len(seq), rel=1e-5)
        assert got[d]["score"] == pytest.approx((loss[0] - loss[1]) / len(seq), rel=1e-3, abs=1e-5)
    assert got[0]["score"] < got[1]["score"]


def test_lm_score_counts_every_ngram_by_itself(spark, monkeypatch):
    """More words and pairs than fit 2^18 and 2^22 cells without sharing; the vocabulary grows with them."""
    monkeypatch.setattr(lmscore, "VOCABULARY", 1000)
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 1 << 16)
    r = random.Random(8)
    texts = [" ".join(f"W{min(r.randrange(60_000), r.randrange(60_000))}" for _ in range(200)) for _ in range(400)]
    docs = documents(spark, texts).repartition(3, "doc_id")
    models = lmscore.train(docs, spark.createDataFrame([(k,) for k in range(0, 400, 2)], "doc_id long"))
    got = {r["doc_id"]: r for r in lmscore.score_documents(docs, models).collect()}
    seqs = [["", *t.lower().split()] for t in texts]
    words, pairs = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for d, seq in enumerate(seqs):
        for k in (0, 1) if d % 2 == 0 else (1,):
            for w in seq:
                words[k][w] += 1
            for p in zip(seq[:-1], seq[1:], strict=True):
                pairs[k][p] += 1
    v = len(words[1]) - 1
    assert models.words == models.vocabulary == v > 1000
    for d, seq in enumerate(seqs):
        loss = [0.0, 0.0]
        for k, n in ((0, 40_000), (1, 80_000)):
            for a, b in zip(seq[:-1], seq[1:], strict=True):
                loss[k] -= math.log(lmscore.MIX * pairs[k][a, b] / max(words[k][a], 1) + (1 - lmscore.MIX) * (words[k][b] + 1) / (n + v)) / 200
        assert (got[d]["n_tokens"], got[d]["target_loss"], got[d]["background_loss"]) == (200, pytest.approx(loss[0], rel=1e-9), pytest.approx(loss[1], rel=1e-9))


# --- 2 ---------------------------------------------------------------------------------------------------------------


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(texts, items):
    out = []
    for text in texts:
        w, hit, found = item_words(text), set(), set()
        for name, item in items:
            i = item_words(item)
            size = min(10, len(i))
            windows = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if size else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def brute_longest(text, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, best = split(text), None
    for _, t in items:
        p = split(t)
        for i in range(len(w)):
            for j in range(len(p)):
                n = 0
                while i + n < len(w) and j + n < len(p) and w[i + n] == p[j + n]:
                    n += 1
                if p and n >= min(window, len(p)) and (best is None or (n, -i) > (best[0], -best[1])):
                    best = (n, i)
    return best


ITEMS = [(1, " ".join(TEXTS[15].split(" ")[12:30])), (2, "w1"), (3, None), (4, "..."), (None, "w2 w3"), (10, TEXTS[20]), (10, "w5, W6"), (11, "zz " * 12), (12, TEXTS[33][:2000])]


@pytest.mark.parametrize("most", [decontaminate.ITEM_BYTES, 3000])
def test_benchmark_hits(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", most)
    texts = [*TEXTS, "W1", "zz " * 30, "w5 w6 w5 W6"]
    docs, items = documents(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.benchmark_hits(docs, items).collect()}
    want = brute_hits(texts, [i for i in ITEMS if i[0] is not None])
    assert len(got) == len(texts)
    for k, (n, hit, found) in enumerate(want):
        assert (got[k]["n_words"], sum(h["n"] for h in got[k]["hits"]), got[k]["items"]) == (n, hit, found)
        assert (got[k]["longest"] and got[k]["longest"][:2]) == brute_longest(texts[k], [i for i in ITEMS if i[0] is not None])
    left = decontaminate.remove_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k, w in enumerate(want) if not w[1]]


def test_longest_matches(spark):
    docs = documents(spark, ["a b c d e f", "x b c d e y", None])
    items = spark.createDataFrame([(7, "b c d e f g")], "item_id long, text string")
    got = {r["item_start"]: (r["n_words"], r["doc"], r["doc_start"]) for r in decontaminate.longest_matches(docs, items, window=3).collect()}
    assert got == {0: (5, 0, 1), 1: (4, 0, 2), 2: (3, 0, 3)}


def test_decontaminate_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(documents(spark, TEXTS[:3]), items).selectExpr("sum(size(hits))").first()[0] == 0
    assert decontaminate.remove_contaminated(documents(spark, []), items).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------

NASTY = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<<||", "a<", "|b", "\n\n", "<\\\\|", "é" * 5]


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([("user", NASTY[k]) if k % 2 else ("assistant", NASTY[k]) for k in range(9)])]
    rows += [(3, k, "assistant" if k % 3 else "a\nb\\n", f"t{k}") for k in range(3 * chat.SEGMENT + 5)]
    rows += [(4, 0, None, None), (4, 0, "user", "b"), (4, 0, "user", "b"), (None, 1, "assistant", "lost"), (5, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "conv_id")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and not got[c]["rewrites"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.chat_template([(r, x) for _, _, r, x in turns]))


def test_black_box_templates(spark):
    def trailer(turns):
        return "<s>" + "".join(f"[{r}]{x}" for r, x in turns) + "</s>"

    out, spans = chat.locate(trailer, [], [("u", "hi"), ("a", "yo")])
    assert [out[s[2] : s[3]] for s in spans] == ["hi", "yo"] and out == "[u]hi[a]yo"

    def forgetful(turns):
        return "".join(f"{r}:{x if k == len(turns) - 1 else '-'};" for k, (r, x) in enumerate(turns))

    with pytest.raises(chat.Rewrites):
        chat.locate(forgetful, [], [("u", "hi"), ("a", "yo")])
    df = spark.createDataFrame([(1, 0, "u", "hi"), (1, 1, "a", "yo")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df, forgetful).first()["rewrites"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_with_a_long_memory(spark):
    """Templates whose state only the real prefix shows, on conversations longer than a segment."""
    turns = [("a" if k % 2 else "u", f"t{k}") for k in range(70)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")

    def numbered(turns):
        return "<s>" + "".join(f"[{k}{r}]{x}" for k, (r, x) in enumerate(turns)) + "</s>"

    rows = chat.format_conversations(df, numbered, "a").orderBy("segment").collect()
    assert "".join(r["formatted"] for r in rows) == numbered(turns) and len(rows) == 3 and not any(r["rewrites"] for r in rows)
    assert [r["formatted"][s["text_start"] : s["text_end"]] for r in rows for s in r["spans"]] == [x for _, x in turns]
    assert [s["loss"] for r in rows for s in r["spans"]] == [r == "a" for r, _ in turns]

    def last(turns):
        return "".join(f"[{r}]{x}" for r, x in turns[-40:])

    (row,) = chat.format_conversations(df, last).collect()
    assert row["rewrites"] and row["formatted"] == last(turns) and row["spans"] == []


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "run"), [(1 << 19, 1024), (7, 2), (1, 3)])
def test_token_counts(spark, monkeypatch, block, run):
    monkeypatch.setattr(tokencounts, "RUN", run)
    texts = ["hello world", None, "", "a <|endoftext|> b", *TEXTS[20:24]]
    docs = documents(spark, texts).repartition(2, "doc_id")
    blocks = tokencounts.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, block_tokens=block)
    rows = tokencounts.scan_tokens(blocks, 50256).collect()
    encode = tokencounts._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(encode(t or "")) for k, t in enumerate(texts)}
    for file in {r["file"] for r in rows}:
        at = 0
        for k, r in enumerate(sorted((r for r in rows if r["file"] == file), key=lambda r: r["ordinal"])):
            assert (r["ordinal"], r["start"], r["ended"]) == (k, at, True)
            at += r["n_tokens"] + 1


def test_raw_token_files(spark, tmp_path):
    np.array([5, 9, 9, 1, 2, 3, 4, 9, 8, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    np.array([1, 2, 3, 4, 5, 6, 7], "<u2").tofile(tmp_path / "d.bin")
    for size in (3, 4, 100):
        rows = tokencounts.scan_tokens(tokencounts.read_token_files(spark, str(tmp_path / "*.bin"), size), 9).collect()
        found = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["ordinal"]):
            found[r["file"]].append((r["start"], r["n_tokens"], r["ended"]))
        assert sorted(found.values()) == sorted([[(0, 1, True), (2, 0, True), (3, 4, True), (8, 2, False)], [(0, 0, True)], [(0, 7, False)]])


def test_one_raw_token_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "TASK_BYTES", 2000)
    ids = np.random.default_rng(1).integers(0, 60, 20_000).astype("<u2")
    (tmp_path / "a name").mkdir()
    ids.tofile(tmp_path / "a name" / "a.bin")
    blocks = tokencounts.read_token_files(spark, str(tmp_path / "a name"), 100)
    assert blocks.rdd.getNumPartitions() == 20 and blocks.count() == 200
    ends = np.flatnonzero(ids == 9)
    want = [(int(b) + 1, int(e - b - 1)) for b, e in zip(np.concatenate([[-1], ends[:-1]]), ends, strict=True)]
    got = sorted((r["start"], r["n_tokens"]) for r in tokencounts.scan_tokens(blocks, 9).where("ended").collect())
    assert got == want
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.bin").write_bytes(b"")
    assert tokencounts.scan_tokens(tokencounts.read_token_files(spark, str(tmp_path / "none")), 9).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1000] = x[700]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 15 + [None]), (2400, [1.0, 2.0]), (None, [1.0] * 16), (2500, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(r[2] == d[r[1]] for r in rows)
        hit += len(set(best) & {r[1] for r in rows})
    assert hit >= 0.9 * 150
    assert [r[1] for r in sorted(got[700])] == list(range(701, 711))
    assert set(got) == set(range(0, 1500, 100))


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, lambda i: i == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 0.0), (1, math.sqrt(2))]
    assert ann.nearest(df.limit(0), lambda i: i == 0).count() == 0


@pytest.mark.parametrize("rows", [40, 3000])
def test_nearest_repeated_ids(spark, rows):
    """Rows, not ids, are queries and candidates; 3,000 rows in one task make it rank by codes."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(rows, 8)), 1)
    ids = [k // 2 for k in range(rows)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 10 == 0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = many = 0
    for q in sorted(set(ids)):
        if q % 10:
            assert q not in got
            continue
        assert sorted(r[0] for r in got[q]) == sorted(2 * [1, 2, 3, 4, 5])
        want = []
        for own in (2 * q, 2 * q + 1):
            d = np.sqrt(((x - x[own]) ** 2).sum(1))
            want += sorted((d[k], ids[k]) for k in range(rows) if k != own)[:5]
        many += len(want)
        hit += len({(s, i) for _, i, s in got[q]} & set(want)) / len(set(want)) * len(want)
    assert hit >= 0.9 * many


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = spark.createDataFrame([(i, t) for i, t in marked.items() if not held(i)], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.train(docs, known)).collect()}
    test = [i for i in marked if held(i)]
    right = sum((score[i] >= 0.3) == (marked[i] == 1) for i in test)
    assert right / len(test) >= 0.98


def test_toxicity_edges(spark):
    docs = documents(spark, ["you idiot", "kind words here", "idiot idiot", "nice day", None, "", "x" * 100_000] * 6)
    labels = spark.createDataFrame([(k, 1 if k % 7 in (0, 2) else 0) for k in range(42) if k % 7 < 4] + [(4, None), (None, 1)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert rows[0] > 0.5 > rows[1] and all(0 <= s <= 1 for s in rows.values()) and rows[4] == rows[5]
    kept = toxicity.remove_toxic(docs, toxicity.train(docs, labels), 0.5)
    assert kept.columns == docs.columns and {r["doc_id"] % 7 for r in kept.collect()} >= {1, 3, 5}
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.5}


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_groups(texts, shingle, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def family(seed, n=90, words=130):
    """Copies of one text with ever more edits, so that links chain and many pairs lie near the threshold."""
    r = random.Random(seed)
    base = [f"v{r.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(12)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(3)] = [f"e{r.randrange(40)}"] * r.randrange(3)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("shingle", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (3, 60, 4)])
def test_similar_groups(spark, shingle, percent, seed):
    texts = TEXTS + family(seed) + family(seed + 10, 40, 12)
    random.Random(seed).shuffle(texts)
    docs = documents(spark, texts).repartition(3, "doc_id")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs, shingle=shingle, percent=percent).collect()}
    want = brute_groups(texts, shingle, percent)
    assert [got[k] for k in range(len(texts))] == want
    kept = jaccard.keep_one(docs, shingle=shingle, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, w in enumerate(want) if w[1] == k]


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for n in (20, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(n * 0.95)], rng.integers(0, 1 << 63, n // 20).astype(np.uint64))))
        x, y = jaccard.parity(a, 85), jaccard.parity(b, 85)
        w = min(len(x), len(y))
        x, y = (z if len(z) == w else z[:w] ^ z[w:] for z in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_bands_leave_room():
    bands = jaccard.Bands(85)
    for n in (1, 6, 7, 30, 1000):
        band, near = bands.of(np.array([n]))
        assert bands.tops[band[0]] >= n
        assert near[0] == (100 * n // 85 > bands.tops[band[0]])
    assert (bands.pieces > bands.differ).all()


def test_similar_groups_ties_and_empty(spark):
    docs = documents(spark, ["a b c d e f g"] * 3 + [None, ""], [5, 5, 3, None, 7])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect())
    assert got == [(-1, 0, None), (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 0, 7)]
    assert jaccard.keep_one(docs).count() == 3
    assert jaccard.similar_groups(documents(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 99), (7, 7), (50, 51), (51, 50)], "a long, b long")
    got = defaultdict(set)
    for r in components(edges).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(41)), [50, 51], [99, 100]]


def test_components_rounds(spark, monkeypatch):
    from factmill.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "written", lambda df, name, real=module.written: rounds.append(name) or real(df, name))
    edges = spark.range(2000).selectExpr("id as a", "id + 1 as b")
    got = components(edges)
    assert got.where("root = 0").count() == 2001 and got.count() == 2001
    assert len(rounds) <= 2 * 14 + 1


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    """What remove_repeated_units must give: rows (id, text) in input order, ids last if None."""
    first, out = {}, {}
    for n, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        w = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", t or "")]
        broken = [k + 1 == len(w) or "\n" in t[w[k][1] : w[k + 1][0]] for k in range(len(w))]
        stop = [broken[k] or t[w[k][1] - 1] in ".!?" for k in range(len(w))]
        units = set()
        for k in range(len(w)):
            if k == 0 or stop[k - 1]:
                ends = [j for j in range(k + least - 1, len(w)) if stop[j]]
                units |= {(k, ends[0])} if ends else set()
            if k == 0 or broken[k - 1]:
                j = next(j for j in range(k, len(w)) if broken[j])
                units |= {(k, j)} if j - k + 1 >= least else set()
        gone, many = set(), 0
        for k, j in sorted(units):
            words = " ".join(t[a:b] for a, b in w[k : j + 1])
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in words)
            at = first.setdefault(key, (n, j))
            if at[0] != n or k > at[1]:
                gone |= set(range(w[k][0], w[j][1]))
                many += 1
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        out[n] = (len(units), many, [(k, next(e for e in range(k, len(t) + 1) if e not in gone) - k) for k in spans], None if t is None else "".join(c for k, c in enumerate(t) if k not in gone))
    return out


@pytest.mark.parametrize("least", [1, 3, 20])
def test_line_dedup(spark, least):
    passage = "One two three. Four five six seven! Éight nine ten eleven twelve? " * 2
    texts = ["A  b\nunique\n\nA  b", "a b \nother\n\n", None, "", "other", "  ", "x" * 20_000 + "\nUNIQUE"]
    texts += ["Lead in " + passage + "and a tail.", "other start. " + passage.replace(". ", ".\n"), "a. " * 60, "a. " * 90, passage, passage, "é. " + passage.upper()]
    ids = [4, 2, 9, 8, None, 7, 1, 20, 21, 22, 23, 24, 24, 25]
    docs = documents(spark, texts, ids).repartitionByRange(3, "doc_id")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["n_units"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept"]) for r in lines.remove_repeated_units(docs, least=least).collect()]
    want = brute_lines(rows, least)
    assert sorted(got, key=repr) == sorted(want.values(), key=repr)
    if least == 20:
        assert sum(n > 0 for _, n, _, _ in got) >= 5
    assert lines.remove_repeated_units(documents(spark, [])).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*TEXTS, "It's we'RE <|endoftext|> x", "日本語 ß ﬁ İ", "1234!?  foo"]
    for most in (64, 4096):
        rows = packing.pack_documents(documents(spark, texts).repartition(2), path, most=most).collect()
        by, seqs = defaultdict(list), defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
            seqs[r["sequence_id"]].append(r)
        whole = packing.word_tokens(path).whole
        for k, t in enumerate(texts):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            at = 0
            for r in sorted(by[k], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ids))
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        for pieces in seqs.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= most
    assert packing.pack_documents(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("most", [1, 7, 32, 64])
def test_packing_short_windows(spark, most):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, ["w " * 100, None, "a. b. c", "x" * 300], [3, 1, 2, 0]).coalesce(1)
    rows = packing.pack_documents(docs, path, most=most).collect()
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= most
    for d in (0, 1, 2, 3):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))]
        assert sum(n for _, n, _ in mine) == mine[0][2]


def test_cuts_are_optimal():
    r = random.Random(1)
    for _ in range(40):
        at = sorted({0, 200, *(r.randrange(200) for _ in range(60))})
        if max(b - a for a, b in zip(at[:-1], at[1:], strict=True)) > 30:
            continue
        price = [0.0, *(r.choice([0, 4, 9]) for _ in at[1:])]
        cuts = packing.choose_cuts(np.array(at), np.array(price), 30)
        best = {0: 0.0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + 30 - (at[j] - at[i]) + price[j] for i in range(j) if at[j] - at[i] <= 30)
        got = sum(30 - (at[b] - at[a]) + price[b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert got == best[len(at) - 1] and cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert sum(packing.in_powers(1000, 4096)) == 1000 and packing.in_powers(4095, 4096) == [4095]


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_repeats(pairs, length):
    first = {}
    for d, t in pairs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in pairs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        out.append((d, len(raw), bytes(c for c, g in zip(raw, gone, strict=True) if not g), [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]))
    return out


@pytest.mark.parametrize("length", [50, 20, 9])
def test_repeats(spark, length):
    texts = TEXTS[:33] + TEXTS[34:]
    ids = list(range(len(texts)))
    random.Random(length).shuffle(ids)
    ids[3] = ids[4]
    got = sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"]), [tuple(x) for x in r["removed"]]) for r in substrings.repeats(documents(spark, texts, ids).repartition(3), length=length).collect())
    assert got == sorted(brute_repeats(list(zip(ids, texts, strict=True)), length))


def test_transform_classes():
    r = random.Random(9)
    text = bytes(r.choice(b"ab") for _ in range(400)) + b"\xff" + bytes(r.choice(b"abc") for _ in range(300)) + b"\xff"
    for length in (8, 13, 50):
        at, kind = substrings.repeated_strings(np.frombuffer(text, np.uint8), length)
        by = defaultdict(set)
        for p, k in zip(at.tolist(), kind.tolist(), strict=True):
            if p + length <= len(text) and b"\xff" not in text[p : p + length]:
                by[k].add(text[p : p + length])
        assert all(len(s) == 1 for s in by.values()) and len(by) == len(set().union(*by.values()))


def test_remove_repeats_keeps_columns(spark):
    text = "é" * 40
    docs = documents(spark, [text, "x" + text, None])
    rows = {r["doc_id"]: r for r in substrings.remove_repeats(docs, count_col="n_chars").collect()}
    assert rows[0]["text"] == text and rows[1]["text"] == "x" and rows[1]["n_chars"] == 1 and rows[2]["text"] is None
    assert substrings.remove_repeats(docs.limit(0)).columns == docs.columns
    assert substrings.repeats(docs.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        rows = spark.createDataFrame(stage(spark, rows, SMALL).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in rows.collect()}
        if name == "suffix_dedup":
            want = {d: kept.decode("utf-8", "ignore") for d, _, kept, _ in brute_repeats(list(before.items()), 50)}
            assert after == want
        elif name == "jaccard":
            order = sorted(before)
            want = brute_groups([before[d] for d in order], 5, 80)
            assert sorted(after) == [d for k, d in enumerate(order) if want[k][1] == k]
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            order = sorted(before)
            hits = brute_hits([before[d] for d in order], items)
            assert sorted(after) == [d for d, h in zip(order, hits, strict=True) if not h[1]]
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
    assert {r["doc_id"] for r in pieces.collect()} == set(after)


def test_empty_tables_and_repeated_rows(spark):
    """Operators 1, 4 and 6: an empty table gives no rows; equal rows are scored and counted one by one, and alike."""
    none = documents(spark, [])
    ids = spark.createDataFrame([(1,)], "doc_id long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    twice = documents(spark, ["a b c d", "a b c d", "w x y z"], [1, 1, 2])
    assert lmscore.score_documents(none, lmscore.train(none, ids)).count() == 0
    got = lmscore.score_documents(twice, lmscore.train(twice, ids)).collect()
    assert len(got) == 3 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
    assert tokencounts.scan_tokens(tokencounts.write_tokens(none, *args), 50256).count() == 0
    counted = tokencounts.scan_tokens(tokencounts.write_tokens(twice, *args), 50256).collect()
    assert sorted(r["doc_id"] for r in counted) == [1, 1, 2] and len({r["n_tokens"] for r in counted if r["doc_id"] == 1}) == 1
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0
    scored = toxicity.score_documents(twice, toxicity.train(twice, labels)).collect()
    assert len(scored) == 3 and len({r["score"] for r in scored if r["doc_id"] == 1}) == 1
