"""Joins documents whose sets of word shingles have a Jaccard similarity of a threshold or more, by parity sketches.

A document's shingle hashes are dealt by value to P pieces, and each piece is the exclusive or of its hashes. A shingle
that only one of two documents has changes one piece at most, so the pieces in which two sketches differ are a lower
bound of the sets' symmetric difference. Similar sets of at most `top` shingles differ in D(top) shingles at most; so
of the D + 1 or more pieces that hold anything, one at least is equal (pigeonhole). Documents meet under equal pieces of
their size band, and those near a band's upper end under the next band's as well. Candidates are then verified on
whole shingle sets. Sets are compared by 64-bit shingle hashes.

Groups of equal pieces are never expanded into rows of pairs: each member is filed under the group's first member. A
document lives on only if so many of its pieces are shared as any similar partner would share. In a first round the live
documents under a first member are verified against their centre, the one that shares most pieces: copies with different
edits are nearer to their origin than to each other. In a second round those whose components still differ are compared
by bit sketches: each hash turns one bit, so the Hamming distance of two sketches is at most the sets' symmetric
difference. Pairs within the bound are verified, so a link that the first round's stars miss is found. No size, partner count or group is capped.

Whether P suffices depends on hash values only: the chance that a document fills fewer than D + 1 pieces is below
1e-8 for the smallest sets and vanishes for larger ones.

Defined results: texts without words have an empty set and no links; a text of fewer than `shingle` words is one
shingle; rows with equal ids are separate documents that may link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm import textarrays as ta
from factmill.llm.chunks import chunked, opened
from factmill.llm.components import components
from factmill.llm.scratch import arrow_rows, release, shuffle_partitions, written

#: Members that are verified against one copy of their group's first member.
MEMBERS = 400
#: Members of a first member whose sketches are compared in one task.
BLOCK = 4096
#: Text of a partition of the exchanges.
PARTITION_BYTES = 64 << 20
#: Low bits of a document's reference are its place in its chunk.
PLACE = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


class Bands:
    """Size bands for a similarity of percent / 100, with each band's D and P."""

    def __init__(self, percent: int, growth: float = 1.6):
        self.percent = percent
        rest = 100 - percent
        same = max(1, (200 - rest) // (2 * rest) if rest else 1)  # sets of up to this size are similar only if equal
        tops, differ, pieces = [same], [0], [1]
        while tops[-1] < 1 << 32:
            low, top = tops[-1], int(tops[-1] * growth) + 2
            d = 2 * top * rest // (100 + percent)
            least = max(1, percent * (low + 1) // 100)  # the smallest set that is dealt here
            p = d + 1 + 12
            for _ in range(100):
                filled = p * (1 - math.exp(-least / p))
                if filled - 5 * math.sqrt(p) * math.exp(-least / p / 2) - 2 >= d + 1 or p > 64 * (d + 1):
                    break
                p += max(4, p // 50)
            tops.append(top)
            differ.append(d)
            pieces.append(max(p, 64) if least < 13 else p)
        self.tops, self.differ, self.pieces = (np.array(x, np.int64) for x in (tops, differ, pieces))

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and whether a similar set can lie in the next."""
        band = np.searchsorted(self.tops, n)
        return band, (100 * n // self.percent if self.percent else n) > self.tops[band]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, ascending within a row, and each row's number of them."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, ta.U64), np.zeros(rows, np.int64)
    low = _LOWER[raw]
    begin, end, _ = ta.runs(low != 32, offsets)
    h = ta.stretch_hash(ta.prefix_hash(low), begin, end)
    word = np.searchsorted(begin, offsets)
    n = np.diff(word)
    grams = ta.sequence_hash(h, shingle)
    out, sizes = [], np.zeros(rows, np.int64)
    for k in np.flatnonzero(n).tolist():
        a, b = int(word[k]), int(word[k + 1])
        if b - a < shingle:
            one = ta.sequence_hash(h[a:b], b - a)
        else:
            one = np.sort(grams[a : b - shingle + 1])
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        sizes[k] = len(one)
        out.append(one)
    return (np.concatenate(out) if out else np.zeros(0, ta.U64)), sizes


def sketch(sets: np.ndarray, sizes: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For the documents' own bands (0) and the next ones (1): filled pieces' keys, their rows, and each row's filled pieces less D."""
    band, near = bands.of(sizes)
    for up in (0, 1):
        take = (sizes > 0) & (near if up else True)
        mine = band + up
        row = np.repeat(np.arange(len(sizes)), sizes)
        part = take[row]
        row, h = row[part], sets[part]
        if not len(h):
            continue
        piece = ((h >> ta.U64(32)) * bands.pieces[mine[row]].astype(ta.U64)) >> ta.U64(32)
        start = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))))
        value = np.bitwise_xor.reduceat(h, start)
        row, piece = row[start], piece[start]
        key = ta.mix(ta.mix(value) + (piece << ta.U64(8)) + mine[row].astype(ta.U64))
        filled = np.bincount(row, minlength=len(sizes))
        yield up, key, row, filled - bands.differ[mine]


class Chunk:
    """A chunk's shingle sets; of rows with equal sets only the first is sketched."""

    def __init__(self, rows, id_col: str, text_col: str, shingle: int):
        batch = opened(rows)
        self.raw, self.offsets = ta.flat(batch.column(batch.schema.get_field_index(text_col)))
        self.ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
        self.sets, self.sizes = shingle_sets(self.raw, self.offsets, shingle)
        first = np.cumsum(self.sizes) - self.sizes
        some = np.flatnonzero(self.sizes)
        self.same = np.arange(len(self.sizes))
        if len(some):
            one = np.add.reduceat(self.sets, first[some])
            two = np.add.reduceat(ta.mix(self.sets ^ ta.U64(0x5851F42D4C957F2D)), first[some])
            _, lead, number = np.unique(np.stack((one, two, self.sizes[some].astype(ta.U64)), 1), axis=0, return_index=True, return_inverse=True)
            self.same[some] = some[lead[number.reshape(-1)]]

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets with those of other rows emptied."""
        return self.sets[np.repeat(keep, self.sizes)], np.where(keep, self.sizes, 0)


def _deal(chunk: int, parts: Iterator, buckets: int) -> pa.RecordBatch | None:
    """Keys to the buckets that own them: each entry is a row's place, the band flag, and six bytes of the key."""
    keys, who = [], []
    for up, key, row, _ in parts:
        keys.append(key)
        who.append(row * 2 + up)
    if not keys:
        return None
    key, who = np.concatenate(keys), np.concatenate(who)
    bucket = ((key >> ta.U64(32)) * ta.U64(buckets) >> ta.U64(32)).astype(np.int64)
    order = np.lexsort((who, bucket))
    key, who, bucket = key[order], who[order], bucket[order]
    first = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(first)).tolist()
    columns = [pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64())]
    columns.append(pa.array([ta.pack(key[first[k] : first[k + 1]], 6) for k in some], pa.binary()))
    columns.append(pa.array([who[first[k] : first[k + 1]].astype("<u4").tobytes() for k in some], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "who"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The groups of two or more entries of a partition: keys in order, the entries (reference * 2 + band flag)."""
    keys, who = [], []
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column(2)[k].is_valid:
                keys.append(ta.unpack(batch.column(2)[k].as_py(), 6) | ta.U64((batch.column(0)[k].as_py() & 0xFFFF) << 48))
                who.append(np.frombuffer(batch.column(3)[k].as_py(), "<u4").astype(np.int64) + (batch.column(1)[k].as_py() << (PLACE + 1)))
    if not keys:
        return np.zeros(0, ta.U64), np.zeros(0, np.int64)
    key, entry = np.concatenate(keys), np.concatenate(who)
    del keys, who
    order = np.argsort(key)
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return sorted_[keep], entry[order[keep]]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(key))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, its entries in groups: the group's first member and how often it leads there."""
    info = []

    def told() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(4)[k].is_valid:
                    info.append((batch.column(1)[k].as_py(), None, batch.column(4)[k].as_py()))
            yield batch

    key, entry = _gathered(told())
    if len(key):
        first, size = _groups(key)
        lead = np.repeat(np.minimum.reduceat(entry, first), size) >> 1
        order = np.lexsort((lead, entry))
        entry, lead = entry[order], lead[order]
        fresh = np.flatnonzero(np.concatenate(([True], (entry[1:] != entry[:-1]) | (lead[1:] != lead[:-1]))))
        count = np.diff(fresh, append=len(entry))
        entry, lead = entry[fresh], lead[fresh]
        chunk = entry >> (PLACE + 1)
        begin, many = _groups(chunk)
        row = np.stack((entry & ((2 << PLACE) - 1), lead, count), 1).astype("<i8")
        for a, n in zip(begin.tolist(), many.tolist(), strict=True):
            info.append((int(chunk[a]), row[a : a + n].tobytes(), None))
    for k in range(0, len(info), 500):
        part = info[k : k + 500]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], ["chunk", "led", "info"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All documents with their sizes, whether a partner is possible, and the candidate links of those that live."""
    led: dict[int, list[bytes]] = {}
    info: dict[int, bytes] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            chunk = batch.column(0)[k].as_py()
            if batch.column(1)[k].is_valid:
                led.setdefault(chunk, []).append(batch.column(1)[k].as_py())
            else:
                info[chunk] = batch.column(2)[k].as_py()
    for chunk, data in info.items():
        table = np.frombuffer(data, "<i8").reshape(-1, 6)  # id, id is null, size, same as, pieces needed (own, next band)
        n = len(table)
        ref = (chunk << PLACE) + np.arange(n)
        rows = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in led.get(chunk, [])] or [np.zeros((0, 3), np.int64)])
        shared = np.bincount(rows[:, 0], weights=rows[:, 2], minlength=2 * n).reshape(n, 2)
        enough = (shared > 0) & (shared >= table[:, 4:6])
        live = enough.any(1)
        links = rows[enough.reshape(-1)[rows[:, 0]]] if len(rows) else rows
        links = np.unique(np.stack((ref[links[:, 0] >> 1], links[:, 1]), 1), axis=0)
        links = links[links[:, 0] != links[:, 1]]
        same = (chunk << PLACE) + table[:, 3]
        ids = pa.array(table[:, 0], mask=table[:, 1] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(ref), pa.array(same), ids, pa.array(table[:, 2]), pa.array(shared[:, 0].astype(np.int64)), pa.array(live)], _TABLE)
        if len(links):
            nothing = pa.nulls(len(links), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), nothing, nothing, nothing, pa.nulls(len(links), pa.bool_())], _TABLE)


_TABLE = ["ref", "other", "id", "n", "shared", "live"]


def _verified(pairs: DataFrame, chunks: DataFrame, text_col: str, parts: int, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. Each a's text is sent once per MEMBERS of its partners, each b's once per pair."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).cast("int").alias("salt"))
    wanted = salted.select("a", "salt", F.col("b").alias("ref"), F.lit(1).alias("role")).unionAll(salted.select("a", "salt", F.col("a").alias("ref"), F.lit(0).alias("role")).distinct())
    lists = wanted.groupBy(F.shiftright("ref", PLACE).alias("chunk")).agg(F.collect_list(F.struct((F.col("ref") % (1 << PLACE)).alias("place"), "a", "salt", "role")).alias("wanted"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                batch_ = opened(rows.as_buffer())
                text = batch_.column(batch_.schema.get_field_index(text_col)).cast(pa.string())
                for k in range(0, len(wanted), 512):
                    part = wanted[k : k + 512]
                    place = pa.array([x["place"] for x in part], pa.int64())
                    columns = [pa.array([x["a"] for x in part], pa.int64()), pa.array([x["salt"] for x in part], pa.int32()), pa.array([x["role"] for x in part], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([(chunk << PLACE) + x["place"] for x in part], pa.int64()), text.take(place)], ["a", "salt", "role", "ref", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine = None, np.zeros(0, ta.U64)
        for batch in batches:
            raw, offsets = ta.flat(batch.column(4))
            a, role, ref = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for x, y in ta.blocks(offsets):
                sets, sizes = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], shingle)
                end = np.cumsum(sizes).tolist()
                for k in range(x, y):
                    one = sets[end[k - x] - int(sizes[k - x]) : end[k - x]]
                    if role[k] == 0:
                        lead, mine = a[k], one.copy()
                        continue
                    if lead != a[k]:
                        raise ValueError("a group came without its first member")
                    place = np.searchsorted(mine, one)
                    both = int((mine[np.minimum(place, len(mine) - 1)] == one).sum()) if len(mine) else 0
                    if both and 100 * both >= percent * (len(mine) + len(one) - both):
                        out.append((a[k], ref[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    sent = chunks.select("chunk", "rows").join(lists, "chunk").mapInArrow(texts, "a long, salt int, role int, ref long, text string")
    return sent.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, "a long, b long")


def _most(a, b, percent: int):
    """The largest symmetric difference of similar sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def parity(one: np.ndarray, percent: int) -> np.ndarray:
    """A set's bit sketch: each hash turns one of 2**k bits, at least 16 for each element in which a similar set may differ."""
    bits = 1 << max(8, (16 * int(_most(len(one), 100 * len(one) // percent, percent))).bit_length())
    turned = np.bincount((one & ta.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<u8")


def _close(sketch_: list[np.ndarray], label: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members whose labels differ and whose sketches don't rule a link out. Side 0 meets side 1, side 2 all."""
    width = np.array([len(x) for x in sketch_])
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        x = np.stack([sketch_[k] for k in mine])
        near = np.flatnonzero((width == w) | (width == 2 * w))
        y = np.stack([sketch_[k] if width[k] == w else sketch_[k][:w] ^ sketch_[k][w:] for k in near])
        for k, i in enumerate(mine.tolist()):
            fits = (label[near] != label[i]) & ((width[near] > w) | (near > i)) & ((side[near] != side[i]) | (side[i] == 2))
            fits &= 100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])
            some = np.flatnonzero(fits)
            if len(some):
                far = np.bitwise_count(y[some] ^ x[k]).sum(1, dtype=np.int64)
                other = near[some[far <= _most(n[near[some]], n[i], percent)]]
                if len(other):
                    yield np.full(len(other), i), other


def _crossing(members: DataFrame, roots: DataFrame, chunks: DataFrame, parts: int, how: tuple, percent: int) -> DataFrame:
    """The second round. Similar documents share a piece, so both met that piece's first member: of the members of each
    first member, those pairs whose components still differ and whose parity sketches are close enough to verify.

    A group is cut into blocks of BLOCK members, and blocks meet in tasks of their own.
    """
    id_col, text_col, shingle = how
    labelled = members.select("a", "ref").join(roots.withColumnRenamed("node", "ref"), "ref", "left").select("a", "ref", F.coalesce("root", "ref").alias("label"))
    open_ = labelled.groupBy("a").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    blocked = labelled.join(open_.select("a", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "a").withColumn("block", F.pmod(F.xxhash64("ref"), "blocks").cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    asked = blocked.select("a", "ref", "label", F.explode(met).alias("m")).select("a", "ref", "label", "m.*")
    lists = asked.groupBy(F.shiftright("ref", PLACE).alias("chunk")).agg(F.collect_list(F.struct((F.col("ref") % (1 << PLACE)).alias("place"), "a", "label", "i", "j", "side")).alias("asked"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                c = Chunk(rows.as_buffer(), id_col, text_col, shingle)
                end = np.cumsum(c.sizes)
                made: dict[int, bytes] = {}
                for k in range(0, len(asked), 1024):
                    part = asked[k : k + 1024]
                    for x in part:
                        if (q := x["place"]) not in made:
                            made[q] = parity(c.sets[end[q] - c.sizes[q] : end[q]], percent).tobytes()
                    columns = [pa.array([x[f] for x in part], t) for f, t in (("a", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("label", pa.int64()))]
                    columns += [pa.array([(number << PLACE) + x["place"] for x in part], pa.int64()), pa.array([int(c.sizes[x["place"]]) for x in part], pa.int64()), pa.array([made[x["place"]] for x in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "i", "j", "side", "label", "ref", "n", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            side, label, ref, n = (np.array([h[q] for h in held]) for q in range(4))
            found = list(_close([np.frombuffer(h[4], "<u8") for h in held], label, n, side, percent))
            if found:
                x, y = (np.concatenate(z) for z in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ref[x], ref[y])), pa.array(np.maximum(ref[x], ref[y]))], ["a", "b"])

        for batch in batches:
            columns = [batch.column(q).to_pylist() for q in range(8)]
            for a, i, j, *rest in zip(*columns, strict=True):
                if (a, i, j) != key:
                    if held:
                        yield from close()
                    key, held = (a, i, j), []
                held.append(rest)
        if held:
            yield from close()

    sent = chunks.select("chunk", "rows").join(lists, "chunk").mapInArrow(sketches, "a long, i int, j int, side int, label long, ref long, n long, sketch binary")
    return sent.repartition(parts, "a", "i", "j").sortWithinPartitions("a", "i", "j").mapInArrow(meet, "a long, b long").distinct()


def _linked(documents: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents' chunks, and a row per document: ref, id, n and its component's root, null without links."""
    if not 51 <= percent <= 99:
        raise ValueError("percent must lie in [51, 99]")
    spark = documents.sparkSession
    arrow_rows(spark)
    chunks = chunked(documents, text_col)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    bands = Bands(percent)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Chunk(rows.as_buffer(), id_col, text_col, shingle)
                n = len(c.sizes)
                need = np.full((n, 2), 1 << 40, np.int64)

                def parts_of(c=c, need=need, n=n) -> Iterator:
                    for up, key, row, least in sketch(*c.only(c.same == np.arange(n)), bands):
                        need[np.unique(row), up] = np.maximum(least[np.unique(row)], 1)
                        yield up, key, row, least

                dealt = _deal(number, parts_of(), parts)
                if dealt is not None:
                    yield dealt.append_column("info", pa.nulls(dealt.num_rows, pa.binary()))
                ids = c.ids.fill_null(0).to_numpy(zero_copy_only=False)
                table = np.stack((ids, np.asarray(c.ids.is_null()).astype(np.int64), c.sizes, c.same, need[:, 0], need[:, 1]), 1)
                one = [pa.array([number % parts], pa.int64()), pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([table.astype("<i8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, ["bucket", "chunk", "keys", "who", "info"])

    sent = chunks.select("chunk", "rows").mapInArrow(first, "bucket long, chunk long, keys binary, who binary, info binary")
    stars = sent.repartition(parts, "bucket").mapInArrow(_stars, "chunk long, led binary, info binary")
    judged = written(stars.repartition(parts, "chunk").mapInArrow(_judged, "ref long, other long, id long, n long, shared long, live boolean"), "judged")
    release(spark)
    docs = judged.where("live is not null")
    copies = docs.where("ref <> other").select(F.col("other").alias("a"), F.col("ref").alias("b"))
    live = docs.where("live").select("ref", "n", "shared")
    left = judged.where("live is null").select(F.col("other").alias("a"), "ref")
    leads = live.join(left.select(F.col("a").alias("ref")).distinct(), "ref", "left_semi").select(F.col("ref").alias("a"), "ref")
    members = written(left.unionAll(leads).distinct().join(live, "ref"), "members")
    centre = members.groupBy("a").agg(F.max_by(F.struct("ref", "n"), F.struct("shared", -F.col("ref"))).alias("c"))
    met = members.join(centre, "a").where(f"ref <> c.ref and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    pairs = written(met.select(F.col("c.ref").alias("a"), F.col("ref").alias("b")).distinct(), "pairs")
    edges = written(_verified(pairs, chunks, text_col, parts, shingle, percent).unionAll(copies), "edges")
    release(spark)
    roots = components(edges)

    crossing = _crossing(members, roots, chunks, parts, (id_col, text_col, shingle), percent)
    pairs = written(crossing, "pairs")
    release(spark)
    if not pairs.isEmpty():
        found = _verified(pairs, chunks, text_col, parts, shingle, percent)
        roots = components(edges.unionAll(found))
    return chunks, docs.select("ref", "id", "n").join(roots.withColumnRenamed("node", "ref"), "ref", "left")


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id that links of similar sets lead to."""
    base = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    _, table = _linked(base, id_col, text_col, shingle, percent)
    table = table.withColumn("root", F.coalesce("root", -F.col("ref") - 1))  # unlinked rows must not meet in one task
    least = table.where("root >= 0").groupBy("root").agg(F.min("id").alias("least"))
    out = table.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that links lead to from a smaller id, with all their columns. Ties keep one row."""
    chunks, table = _linked(documents, id_col, text_col, shingle, percent)
    linked = table.where("root is not null")
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ref")).alias("least"))
    gone = linked.join(least, "root").where("ref <> least.ref").groupBy(F.shiftright("ref", PLACE).alias("chunk")).agg(F.collect_list(F.col("ref") % (1 << PLACE)).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, out in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                docs = opened(rows.as_buffer())
                keep = np.ones(docs.num_rows, bool)
                keep[out or []] = False
                yield docs.filter(pa.array(keep))

    return chunks.select("chunk", "rows").join(gone, "chunk", "left").mapInArrow(run, documents.schema)
