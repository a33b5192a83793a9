"""Removal of passages that repeat anywhere in a corpus, by seeds that are extended to maximal repeats.

Two equal runs of ``LENGTH`` words hold the same anchor at the same place: the ``SEED``-word run with the smallest hash among
the ``LENGTH - SEED + 1`` in it, the leftmost of equal ones (winnowing). So every window of a text belongs to one anchor, and an
anchor to a stretch of neighbouring windows.

1. Occurrences meet by their anchor's hash. Each is extended both ways over the words of its windows: where two have the
   same extension all their windows repeat, and one of them stands for all. An anchor that occurs once is done.
2. Where an anchor occurs with different extensions, a repeat ends inside: one occurrence of each extension offers its single
   windows, and those that are offered twice repeat.
3. A word in a repeating window is removed. Windows are judged on the input, and overlapping ones together make the maximal repeats.

Occurrences are packed into blocks by destination. Within a block those with the same extension are already found to
repeat, and one of them goes on, and of an anchor with many extensions, which then all offer their windows, only two go on:
neither a text copied a million times nor a phrase in a million texts gathers in a task. Texts are
shuffled once, those with undecided windows twice. Runs of words are compared by two independent 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts, and those under ``LENGTH`` words, lose nothing. A row that is there twice
repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import words as W
from tablewarden.llm.common import keep, total_bytes

LENGTH = 35
SEED = 8
FLUSH = 400_000
BYTES_PER_TASK = 16_000_000
SENT = "part long, blob binary"
_OCCURRENCE = np.dtype([("h", "<u8"), ("c", "<u8"), ("row", "<i8"), ("lo", "<i4"), ("n", "<i2"), ("many", "<i2")])
VERDICT = "row long, lo int, n int, repeats boolean, offers boolean"


def leftmost_minima(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of the ``span`` values from each place on, the leftmost if equal."""
    place, size = np.arange(len(values)), 1
    while 2 * size <= span:
        place = _better(values, place[: len(place) - size], place[size:])
        size *= 2
    rest = span - size
    return _better(values, place[: len(place) - rest], place[rest:]) if rest else place


def _better(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(values[left] <= values[right], left, right)


def occurrences(block: W.Block, rows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The anchors of a block's documents, each with the hash of its extension."""
    inside = block.run_inside(length)
    if not inside.any():
        return np.zeros(0, _OCCURRENCE)
    hashes = block.hashes()
    seeds = block.run_hashes(hashes, seed)
    anchor = leftmost_minima(seeds, length - seed + 1)[: len(inside)]
    at = np.flatnonzero(inside)
    anchor = anchor[at]
    head = np.ones(len(at), bool)
    head[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(at)) - 1
    sums, base = W.run_sums(hashes, 1)
    lo, hi, place = at[first], at[last], anchor[first]
    doc = np.searchsorted(block.first, lo, side="right") - 1
    out = np.zeros(len(lo), _OCCURRENCE)
    out["h"] = seeds[place]
    out["c"] = W.mix(W.span_hashes(sums, base, lo, hi + length) + (place - lo).astype(np.uint64))
    out["row"], out["lo"], out["n"] = rows[doc], lo - block.first[doc], hi - lo + 1
    return out


def _same(a: np.ndarray, fields: list[str]) -> np.ndarray:
    """For ordered records: whether each begins a new group of equal ``fields``."""
    head = np.ones(len(a), bool)
    for k, f in enumerate(fields):
        differs = a[f][1:] != a[f][:-1]
        head[1:] = differs if not k else head[1:] | differs
    return head


def _combine(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one record for each anchor and extension, its ``many`` set if there are more; all records of the latter)."""
    found = found[np.lexsort((found["lo"], found["row"], found["c"], found["h"]))]
    head = _same(found, ["h", "c"])
    group = np.cumsum(head) - 1
    times = np.bincount(group, minlength=int(head.sum()))
    many = (times > 1) | (np.bincount(group, weights=found["many"], minlength=len(times)) > 0)
    one = found[head]
    one["many"] = many
    return one, found[many[group]]


def _settle(found: np.ndarray, by_seed: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a block sends on, and what is decided in it: records that repeat (``many``) and those that offer their windows."""
    one, repeated = _combine(found)
    repeated["many"] = 1
    if not by_seed:
        return one, repeated
    head = _same(one, ["h"])
    last = np.append(head[1:], True)
    offers = one[~(head & last)]
    offers["many"] = 0
    return one[head | last], np.concatenate([repeated, offers])


def _verdicts(records: np.ndarray, repeats: np.ndarray, offers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(records["row"]), pa.array(records["lo"]), pa.array(records["n"].astype(np.int32)), pa.array(repeats), pa.array(offers)],
        names=["row", "lo", "n", "repeats", "offers"],
    )


def _send(parts: int, forward: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
    """Packed records by destination; those that are done already go anywhere, under negative numbers."""
    rows = []
    for records, sign in ((forward, 1), (done, -1)):
        part = ((records["h"] if sign > 0 else records["row"].view("<u8")) >> np.uint64(20)) % np.uint64(parts)
        order = np.lexsort((records["lo"], records["row"], part))
        records, part = records[order], part[order]
        kinds, at = np.unique(part, return_index=True)
        cut = [*at.tolist(), len(part)]
        for p, i, j in zip(kinds.tolist(), cut[:-1], cut[1:], strict=True):
            columns = records[i:j]
            rows.append((int(p) if sign > 0 else -1 - int(p), b"".join(columns[f].tobytes() for f in _OCCURRENCE.names)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])


def _unpack(blob: bytes) -> np.ndarray:
    out, at = np.zeros(len(blob) // _OCCURRENCE.itemsize, _OCCURRENCE), 0
    for f in _OCCURRENCE.names:
        size = _OCCURRENCE[f].itemsize * len(out)
        out[f] = np.frombuffer(blob[at : at + size], _OCCURRENCE[f])
        at += size
    return out


def meet(source: DataFrame, make, parts: int, by_seed: bool, flush: int = FLUSH) -> DataFrame:
    """``VERDICT`` rows for the records that ``make`` gets from Arrow batches.

    With ``by_seed``, records of one ``h`` and different ``c`` offer their windows; else only equal records count.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for records in make(batch):
                kept.append(records)
                n += len(records)
                if n >= flush:
                    yield _send(parts, *_settle(np.concatenate(kept), by_seed))
                    kept, n = [], 0
        if n:
            yield _send(parts, *_settle(np.concatenate(kept), by_seed))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if part < 0:
                    records = _unpack(blob)
                    yield _verdicts(records, records["many"] > 0, records["many"] == 0)
                else:
                    kept.append(_unpack(blob))
        if not kept:
            return
        one, repeated = _combine(np.concatenate(kept))
        yield _verdicts(repeated, np.ones(len(repeated), bool), np.zeros(len(repeated), bool))
        if by_seed:
            head = _same(one, ["h"])
            group = np.cumsum(head) - 1
            offers = np.bincount(group)[group] > 1
            yield _verdicts(one[offers], np.zeros(int(offers.sum()), bool), np.ones(int(offers.sum()), bool))

    return source.mapInArrow(send, SENT).repartition(parts, "part").mapInArrow(join, VERDICT)


def removed_words(n_words: int, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Marks the words of the windows that begin at each start and the ``size - 1`` places after it."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(n_words, starts + sizes - 1 + length), -1)
    return np.cumsum(step[:-1]) > 0


def _kept_text(block: W.Block, d: int, removed: np.ndarray) -> bytes:
    at = np.arange(block.first[d], block.first[d + 1])[~removed]
    data = block.data.tobytes() if len(block.data) < 1 << 12 else memoryview(block.data)
    return b" ".join([bytes(data[a:z]) for a, z in zip(block.start[at].tolist(), block.end[at].tolist(), strict=True)])


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _all_or_none(rows: DataFrame, length: int) -> DataFrame:
    """Rows that there are twice or more: every window starts elsewhere too, so all words of ``length`` words or more go."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, block in W.blocks(batch):
                counts = [int(c) for c in block.counts[: z - a]]
                gone = [np.full(c, c >= length) for c in counts]
                removed = pa.array([c if c >= length else 0 for c in counts], pa.int64())
                kept = pa.array([_kept_text(block, d, g).decode() for d, g in enumerate(gone)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), pa.array(counts, pa.int64()), removed, kept], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text").mapInArrow(make, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", flush: int = FLUSH
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` has the words that stay, joined by one space; a block has about ``flush`` anchors.

    Equal rows (id and text, told by two hashes) are counted first. One of each goes into the search, for the others' sake; the
    rows themselves need no finds, so however many there are, each is read once more and that is all.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("row", _row_key(F.col("doc_id"), F.col("text")))
    keys = ["row", "check"]
    checked = docs.withColumn("check", F.xxhash64("text", F.length("text"), "doc_id"))
    repeated = keep(checked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-rows")
    if repeated.isEmpty():
        return _among_rows(docs.withColumn("own", F.lit(True)), length, seed, flush)
    single = checked.join(repeated, keys, "left_anti").select("doc_id", "text", "row")
    several = checked.join(repeated, keys, "left_semi")
    one_of_each = several.groupBy(*keys).agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", "row")
    found = _among_rows(keep(single.withColumn("own", F.lit(True)).unionByName(one_of_each.withColumn("own", F.lit(False))), "rows"), length, seed, flush)
    return found.unionByName(_all_or_none(several, length))


def _among_rows(docs: DataFrame, length: int, seed: int, flush: int) -> DataFrame:
    """What is left of different rows (doc_id, text, row, own); those not ``own`` are searched for the others' sake and not returned."""
    parts = max(16, -(-total_bytes(docs) // BYTES_PER_TASK))

    def seeds(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rows = batch.column("row").to_numpy()
        for a, z, block in W.blocks(batch):
            yield occurrences(block, rows[a:z], length, seed)

    first = keep(meet(docs.select("row", "text"), seeds, parts, True, flush), "seeds")
    by_row = first.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "repeats", "offers")).alias("found"))
    joined = docs.join(by_row.hint("shuffle_hash"), "row", "left")
    schema = "row long, doc_id long, own boolean, text string, n_words long, n_removed long, kept string, starts binary, sizes binary, offered binary, keys binary"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            for a, z, block in W.blocks(batch):
                hashes, sums = None, None
                out: list[tuple] = []
                for d in range(z - a):
                    n_words, own = int(block.counts[d]), found[a + d]
                    starts = sizes = np.zeros(0, np.int64)
                    offered = keys = None
                    if own.is_valid:
                        flat = own.values
                        lo, n, repeats, offers = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                        starts, sizes = lo[repeats].astype(np.int64), n[repeats].astype(np.int64)
                        if offers.any():
                            if hashes is None:
                                hashes = block.hashes()
                                sums = [W.run_sums(hashes, k) for k in (0, 1)]
                            at = np.unique(np.concatenate([np.arange(x, x + m) for x, m in zip(lo[offers].tolist(), n[offers].tolist(), strict=True)]))
                            place = at + block.first[d]
                            keys = np.stack([W.span_hashes(s, b, place, place + length) for s, b in sums], axis=1).tobytes()
                            offered = at.astype("<i4").tobytes()
                    if offered is None:
                        gone = removed_words(n_words, starts, sizes, length)
                        out.append((None, n_words, int(gone.sum()), _kept_text(block, d, gone).decode(), None, None, None, None))
                    else:
                        whole = bytes(block.data[block.cut[d] : block.cut[d + 1]]).decode()
                        out.append((whole, n_words, None, None, starts.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), offered, keys))
                part = batch.slice(a, z - a)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4]
                names = ["text", "n_words", "n_removed", "kept", "starts", "sizes", "offered", "keys"]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("own"), *(pa.array([o[k] for o in out], kinds[k]) for k in range(8))], names=["row", "doc_id", "own", *names])

    half = keep(joined.select("row", "doc_id", "own", "text", "found").mapInArrow(decide, schema), "decided")

    def windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for row, offered, keys in zip(batch.column("row").to_pylist(), batch.column("offered").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            pair = np.frombuffer(keys, "<u8").reshape(-1, 2)
            out = np.zeros(len(pair), _OCCURRENCE)
            out["h"], out["c"], out["row"], out["lo"], out["n"] = pair[:, 0], pair[:, 1], row, np.frombuffer(offered, "<i4"), 1
            yield out

    unsure = half.where("offered is not null")
    second = meet(unsure.select("row", "offered", "keys"), windows, parts, False, flush)
    hits = second.groupBy("row").agg(F.collect_list("lo").alias("hits"))
    final = unsure.where("own").select("row", "doc_id", "text", "n_words", "starts", "sizes").join(hits.hint("shuffle_hash"), "row", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes, hits = (batch.column(c) for c in ("starts", "sizes", "hits"))
            for a, z, block in W.blocks(batch):
                n_removed, kept = [], []
                for d in range(z - a):
                    s, n = np.frombuffer(starts[a + d].as_py(), "<i8"), np.frombuffer(sizes[a + d].as_py(), "<i8")
                    if hits[a + d].is_valid:
                        own = hits[a + d].values.to_numpy().astype(np.int64)
                        s, n = np.concatenate([s, own]), np.concatenate([n, np.ones(len(own), np.int64)])
                    gone = removed_words(int(block.counts[d]), s, n, length)
                    n_removed.append(int(gone.sum()))
                    kept.append(_kept_text(block, d, gone).decode())
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    late = final.select("doc_id", "text", "n_words", "starts", "sizes", "hits").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
    return half.where("own and offered is null").select("doc_id", "n_words", "n_removed", "kept").unionByName(late)
