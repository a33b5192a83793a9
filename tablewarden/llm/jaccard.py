"""Similarity join of documents by the Jaccard similarity of their word shingles, by partition of the shingle universe.

Two sets of a size band (partners have at most 100 / percent times the size) that are linked differ in at most H elements.
Shingles are dealt by a hash into more than H segments, so some segment of both is equal (``shingles.Bands`` chooses for each
band, by expected cost, the number of segments, spare ones for those that are empty, and segments that also offer
their one-deletion neighbourhoods). Documents with an equal segment meet by its signature:

1. Documents with equal sets are one class, spoken for by its smallest id.
2. Signatures are packed by destination. Of the documents of a block that share one, a single id travels on together with a
   number for that group, so a signature of a third of all documents travels once for each block. Where signatures meet, the
   smallest id that offers them for its own band becomes their leader. Leaders and members then count as their classes, each once
   for a group, and the groups' numbers bring the leaders back to all their members. So copies make no more pairs than one of
   them, and others at most one for each signature, not the square of their number.
3. A leader and its documents are compared by rows of parities of their sets (``shingles.parities``, a fiftieth of a text). Two
   sets differ in no fewer elements than their rows in bits, so what is too far from all others there is linked with none of them
   and leaves; texts are needed for the others alone.
4. Each pair left is verified exactly on the texts. A leader with many documents is dealt out by salts.
5. Documents of one leader that it isn't linked with may be linked with one another: they are compared by what they differ from
   the leader in, in square blocks of ``BLOCK`` documents, and only edges that span the links found go on.
6. Components of all links give the smallest id that each document reaches.

Two linked documents that are not of one class share a signature, so they share a leader, and step 4 or 5 links them. The work of
steps 3 and 5 grows with the square of the distinct unlinked documents around one leader, in blocks over all tasks; no pair is
written there, and nothing is capped. Null and empty texts have no shingles and are linked with nothing. Rows that share an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import shingles as S
from tablewarden.llm import words as W
from tablewarden.llm.common import fresh_name, keep, short_batches
from tablewarden.llm.graph import components

PERCENT = 85
WIDTH = 4
FLUSH = 600_000
SIGNATURES_PER_TASK = 700_000
LEADER_PART = 2048
CLASS_PART = 1024
SALTS = 64
BLOCK = 512
PARITY_BLOCK = 2048


def set_table(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, n_signatures, parities) for each row of (doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = S.Bands(percent)
        for batch in batches:
            for a, z, block in W.blocks(batch):
                sets = S.shingle_sets(block, width)
                k1, k2 = S.set_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, z - a), pa.array(sets.sizes.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                        pa.array(S.signature_counts(sets.sizes, bands)), pa.array(S.parities(sets), pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "n_signatures", "parities"],
                )

    return docs.mapInArrow(make, "doc_id long, n_shingles long, k1 long, k2 long, n_signatures long, parities binary")


_OFFER = np.dtype([("key", "<u8"), ("doc", "<i8"), ("group", "<u8"), ("larger", "i1")])
_PAIR, _LEADS, _MEMBER = 0, 1, 2


def _groups(key: np.ndarray, doc: np.ndarray, larger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an ``_OFFER`` for each key, members): of a block's documents with one key, the first speaks for the group.

    ``members`` has rows (group, document) for the others; equal groups of several keys are listed once.
    """
    order = np.lexsort((doc, larger, key))
    key, doc, larger = key[order], doc[order], larger[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    cut = np.append(first, len(key))
    out = np.zeros(len(first), _OFFER)
    out["key"], out["doc"], out["larger"] = key[first], doc[first], larger[first]
    many = np.diff(cut) > 1
    number = W.mix(S.group_sums(W.mix(doc.astype(np.uint64)), cut) + W.mix(out["doc"].astype(np.uint64) ^ np.uint64(0x5BD1E995))) | np.uint64(1)
    out["group"] = np.where(many, number, 0)
    _, once = np.unique(out["group"], return_index=True)
    once = once[many[once]]
    size = np.diff(cut)[once] - 1
    at = np.repeat(cut[once] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(once) else np.zeros(0, np.int64)
    members = np.stack([np.repeat(number[once], size).view(np.int64), doc[at]], axis=1)
    return out, members


def _leaders(offers: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs (leader, document), rows (group, its leader)) of offers that meet; most offers meet none and leave first."""
    by_key = np.argsort(offers["key"])
    key = offers["key"][by_key]
    same = key[1:] == key[:-1]
    meets = np.zeros(len(key), bool)
    meets[1:] |= same
    meets[:-1] |= same
    some = by_key[meets | (offers["group"][by_key] != 0)]
    del by_key, key, same, meets
    key, doc, group, larger = (offers[f][some] for f in _OFFER.names)
    order = np.lexsort((doc, larger, key))
    key, doc, group, larger = key[order], doc[order], group[order], larger[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    led = larger[first] == 0  # sets of the larger band alone meet under that band's own signatures
    leader = doc[first]
    pair, grouped = led & (leader != doc), led & (group != 0)
    pairs = np.unique(np.stack([leader[pair], doc[pair]], axis=1), axis=0)
    return pairs, np.unique(np.stack([group[grouped].view(np.int64), leader[grouped]], axis=1), axis=0)


def _pack(offers: np.ndarray) -> bytes:
    """Offers of one part, in order of their documents, in about 9 bytes each.

    The upper half of a key has chosen the part, so the lower one is left to tell: among ``SIGNATURES_PER_TASK`` of them some
    60 pairs meet by chance, which the exact check drops. Documents are steps from the one before, groups are few.
    """
    step = np.diff(offers["doc"], prepend=offers["doc"][:1])
    wide = bool(step.max() >= 1 << 32)
    grouped = np.flatnonzero(offers["group"])
    head = np.array([len(offers), offers["doc"][0], wide, len(grouped)], "<i8")
    key = (offers["key"] & np.uint64(0xFFFFFFFF)).astype("<u4")
    parts = [head, key, step.astype("<i8" if wide else "<u4"), np.packbits(offers["larger"].astype(bool)), grouped.astype("<u4"), offers["group"][grouped]]
    return b"".join(x.tobytes() for x in parts)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n, first, wide, n_groups = np.frombuffer(blob, "<i8", 4).tolist()
    at, out = 32, []
    for dtype, count in (("<u4", n), ("<i8" if wide else "<u4", n), ("u1", -(-n // 8)), ("<u4", n_groups), ("<u8", n_groups)):
        out.append(np.frombuffer(blob, dtype, count, at))
        at += out[-1].nbytes
    key, step, larger, grouped, numbers = out
    group = np.zeros(n, np.uint64)
    group[grouped] = numbers
    return {"key": key, "doc": first + np.cumsum(step, dtype=np.int64), "group": group, "larger": np.unpackbits(larger, count=n).astype(np.int8)}


def _rows(kind: int, pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), kind, np.int8)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["kind", "a", "b"])


def leader_pairs(docs: DataFrame, rep: DataFrame, n_signatures: int, percent: int = PERCENT, width: int = WIDTH, flush: int = FLUSH) -> DataFrame:
    """(a, b): classes b with the leaders a of their signatures, each by its smallest id; ``rep`` has (doc_id, rep) for all documents.

    ``n_signatures`` of them are dealt out in even parts.
    """
    parts = max(12, -(-n_signatures // SIGNATURES_PER_TASK))

    def send(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        offers, members = _groups(*(np.concatenate(c) for c in zip(*kept, strict=True)))
        part = ((offers["key"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((offers["doc"], part))
        offers, part = offers[order], part[order]
        kinds, at = np.unique(part, return_index=True)
        rows = [(p, _pack(offers[i:j])) for p, i, j in zip(kinds.tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True)]
        for i in range(0, len(members), 8192):  # members only pass through
            rows.append((-1 - int(members[i, 1]) % parts, members[i : i + 8192].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = S.Bands(percent)
        kept, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, z, block in W.blocks(batch):
                key, doc, larger = S.signatures(S.shingle_sets(block, width), bands)
                kept.append((key, ids[a:z][doc], larger))
                n += len(key)
                if n >= flush:
                    yield from send(kept)
                    kept, n = [], 0
        if n:
            yield from send(kept)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {f: [] for f in _OFFER.names}
        for batch in batches:
            for part, blob in zip(batch.column("part"), batch.column("blob"), strict=True):
                part, blob = part.as_py(), blob.as_py()
                if part < 0:
                    yield _rows(_MEMBER, np.frombuffer(blob, np.int64).reshape(-1, 2))
                    continue
                for f, values in _unpack(blob).items():
                    kept[f].append(values)
        if kept["key"]:
            pairs, leads = _leaders({f: np.concatenate(kept.pop(f)) for f in _OFFER.names})
            yield _rows(_PAIR, pairs)
            yield _rows(_LEADS, leads)

    sent = docs.mapInArrow(offer, "part long, blob binary").repartition(parts, "part")
    met = keep(sent.mapInArrow(join, "kind byte, a long, b long"), "met")
    rep_a, rep_b = rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), rep.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    of = lambda kind: met.where(F.col("kind") == kind).select("a", "b").join(rep_b, "b")
    # before they meet: copies are members of one group as often as there are of them; one exchange by number does for both steps
    leads = of(_LEADS).select(F.col("a").alias("number"), F.col("rb").alias("a")).repartition("number").distinct()
    members = of(_MEMBER).select(F.col("a").alias("number"), F.col("rb").alias("b")).repartition("number").distinct()
    brought = leads.join(members, "number").where("a <> b").select("a", "b")
    alone = of(_PAIR).join(rep_a, "a").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return alone.unionByName(brought).distinct()


def with_classes(sets: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, rep): the smallest id with an equal set, itself if there is no other; null for empty sets.

    Large classes are joined under salts, the others by their key.
    """
    key = ["n_shingles", "k1", "k2"]
    classes = keep(sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "classes")
    large = classes.where(F.col("n") > CLASS_PART).select(*key, F.col("rep").alias("large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(large, [*key, "salt"], "left")
    salted = keep(salted.select("doc_id", *key, "large"), "salted-sets")
    done = salted.where("large is not null").select("doc_id", "n_shingles", F.col("large").alias("rep"))
    rest = salted.where("large is null").join(classes.where(F.col("n") <= CLASS_PART).select(*key, "rep"), key, "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id"))
    return done.unionByName(rest.select("doc_id", "n_shingles", own.alias("rep")))


def with_partners(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose b may be linked with a or another b of that leader, by the parities in ``sets``."""
    groups = pairs.groupBy("a").agg(F.expr(f"(count(*) + {PARITY_BLOCK}) div {PARITY_BLOCK}").alias("chunks"))
    # a leader is one of its own documents here
    around = pairs.join(groups, "a").unionByName(groups.select("a", F.col("a").alias("b"), "chunks"))
    around = around.withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    rows = sets.where("n_shingles > 0").select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), "parities")
    # a block holds two different chunks, or the only one
    dealt = around.join(rows, "b").withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))).where("chunk <> other or chunks = 1")
    dealt = dealt.select("a", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "b", "n_b", "parities")

    def found(block: pa.Table) -> pa.RecordBatch:
        a, b = block.column("a").to_numpy(), block.column("b").to_numpy()
        some = S.with_partner(block.column("n_b").to_numpy(), block.column("parities").to_pylist(), b, percent) & (a != b)
        return pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last block may go on in the next batch
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            key = np.stack([part.column(c).to_numpy() for c in ("a", "i", "j")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for x, y in zip(cut, cut[1:], strict=False):
                yield found(part.slice(x, y - x))
            rest = part.slice(cut[-1])
        if rest is not None:
            yield found(rest)

    return dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(a, b, n_group, n_b, link, differing) for leader pairs (a, b, n_group, salt), on the texts of (doc_id, text).

    ``differing`` has the shingles in which b differs from a, where a has other documents to compare b with.
    """
    text_b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    text_a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    leaders = pairs.select("a", "salt").distinct()
    # merge joins at every size: the texts are the larger side, and a broadcast of pairs would not last
    both = pairs.join(text_b.hint("merge"), "b").join(leaders.join(text_a.hint("merge"), "a").hint("merge"), ["a", "salt"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a_ids = batch.column("a").to_numpy()
            alone = batch.column("n_group").to_numpy() < 2
            texts_a = batch.column("text_a")
            for i, j, block in W.blocks(batch, "text_b"):
                sets = S.shingle_sets(block, width)
                link, n_b, differing = np.zeros(j - i, bool), sets.sizes.astype(np.int64), []
                for d in range(j - i):
                    leader = int(a_ids[i + d])
                    if leader not in last:
                        _, _, own = next(W.blocks(pa.RecordBatch.from_arrays([texts_a.slice(i + d, 1)], names=["text"])))
                        last = {leader: S.shingle_sets(own, width).item}
                    x, y = last[leader], sets.item[sets.cut[d] : sets.cut[d + 1]]
                    rest = np.setxor1d(x, y, assume_unique=True)
                    common = (len(x) + len(y) - len(rest)) // 2
                    link[d] = len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common)
                    differing.append(None if alone[i + d] else rest.tobytes())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("a", "b", "n_group")), pa.array(n_b), pa.array(link), pa.array(differing, pa.binary())],
                    names=["a", "b", "n_group", "n_b", "link", "differing"],
                )

    return both.select("a", "b", "n_group", "text_a", "text_b").mapInArrow(make, "a long, b long, n_group long, n_b long, link boolean, differing binary")


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    items = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    _, code, times = np.unique(items, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    shared = times[code] > 1
    code, rows = np.unique(code[shared], return_inverse=True)[1], rows[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        i, j = np.searchsorted(code, [low, low + 2048])
        grid = np.zeros((len(left) + len(right), 2048), np.float32)
        grid[rows[i:j], code[i:j] - low] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def compare_block(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Edges that span the links of a square block; ``side`` 0 and 1 are its rows and columns, 2 both."""
    ids, n, link, side = (table.column(c).to_numpy() for c in ("b", "n_b", "link", "side"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("differing").to_pylist()]
    label = np.arange(len(ids))
    size = np.array([len(s) for s in sets], np.int64)
    open_rows = np.flatnonzero(~link & (side != 1))
    other_open = np.flatnonzero(~link & (side == 1))
    tasks = [(open_rows, np.flatnonzero(side != 0)), (np.flatnonzero(side == 0), other_open)]
    edges: list[tuple[int, int]] = []
    for rows, columns in tasks:
        if not len(rows) or not len(columns):
            continue
        common = _common_counts([sets[i] for i in rows], [sets[i] for i in columns])
        apart = size[rows][:, None] + size[columns][None, :] - 2 * common
        near = (100 - percent) * (n[rows][:, None] + n[columns][None, :]) >= (100 + percent) * apart
        for r, c in zip(*np.nonzero(near), strict=True):
            x, y = int(rows[r]), int(columns[c])
            while label[x] != x:
                label[x] = label[label[x]]
                x = int(label[x])
            while label[y] != y:
                label[y] = label[label[y]]
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                edges.append((int(ids[x]), int(ids[y])))
    return edges


def links_around(verified: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): edges that span the links between documents of one leader, where it is not linked with both."""
    # where all are linked with the leader there is nothing to compare, as among copies
    some = keep(verified.where("n_group > 1 and not link").select("a").distinct(), "unlinked")
    many = verified.where("n_group > 1").join(some, "a", "left_semi").withColumn("chunks", F.expr(f"(n_group + {BLOCK - 1}) div {BLOCK}"))
    many = many.withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    square = F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other")
    dealt = many.select("a", "b", "n_b", "link", "differing", "chunk", square).select(
        "a", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.expr("case when chunk = other then 2 when chunk < other then 0 else 1 end").alias("side"), "b", "n_b", "link", "differing",
    )

    def compare(table: pa.Table) -> pa.Table:
        found = compare_block(table, percent) if len(table) > 1 and not all(table.column("link").to_pylist()) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("a", "i", "j").applyInArrow(compare, "a long, b long")


def join_documents(
    docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", flush: int = FLUSH
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; a block has about ``flush`` signatures."""
    docs = short_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sets = keep(set_table(docs, width, percent), "sets")
    spoken = keep(with_classes(sets), "classes")
    total = int(sets.agg(F.sum("n_signatures")).first()[0] or 0)
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rep = spoken.where("doc_id is not null and rep is not null").select("doc_id", "rep").distinct()
    met = keep(leader_pairs(usable, rep, total, percent, width, flush), "pairs")
    pairs = keep(with_partners(met, sets, percent), "near-pairs")
    groups = pairs.groupBy("a").agg(F.count("*").alias("n_group"))
    salted = pairs.join(groups, "a").withColumn("salt", F.expr(f"pmod(xxhash64(b), (n_group + {LEADER_PART - 1}) div {LEADER_PART})"))
    verified = keep(verify(keep(salted, "salted"), usable, percent, width), "verified")
    edges = verified.where("link").select("a", "b").unionByName(links_around(verified, percent))
    found = components(edges)
    joined = spoken.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; equal rows of it once, documents without words all stay."""
    found = keep(join_documents(docs, percent, width, doc_id, text), "components")
    name = fresh_name(docs.columns, "__gone")
    gone = keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    twice = keep(found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), "twice")
    own = docs[f"`{doc_id}`"].cast("long")
    left = docs.join(gone, own == gone[name], "left_anti")
    own = left[f"`{doc_id}`"].cast("long")
    once = left.join(twice, own == twice[name], "left_anti")
    return once.unionByName(left.join(twice, own == twice[name], "left_semi").dropDuplicates([doc_id, text]))
