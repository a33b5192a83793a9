"""Operators on documents against plain Python, over a few hundred real rows and all kinds of odd ones."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewarden.llm import jaccard, language, mixing, packing, pii, quality, queries, repeats, shingles, token_counts
from tablewarden.llm.common import ARROW_ROWS, keep

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "a", "a b", "a b c d", "A B\x0bC\x0cd", "x " * 3000, "é,è;É!! ≠ x\u200by \x1c z a×b İ Σ", "\n\n1 2\n1 2\n\n3", "<|endoftext|> don't I'LL 12,3", "y" * 70000]


@pytest.fixture(scope="module")
def docs(spark):
    real = pd.read_parquet(f"{SMALL}/documents.parquet").head(120)
    texts = [*real["text"], *ODD, *ODD[:4]]
    sources = [*real["source"], *[None] * len(ODD), *["host"] * 4]
    made = [(i, t, "en" if i % 3 else None, s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    made += [made[5], made[5], (None, "null id text of some words here", "en", "src1", 3), (900, real["text"][7], "en", "src2", 3)]
    return made, keep(spark.createDataFrame(made, COLUMNS).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    made, df = docs
    got = quality.judge(df.select("doc_id", "source", "text"))
    want = sorted(((d, *base_counts(t)) for d, t, *_ in made), key=repr)
    assert rows(got, "doc_id", *(f"__{c}" for c in quality.COUNTS)) == want


def test_quality_rejects_bad_hosts_and_keeps_columns(spark, empty):
    good = " ".join(f"w{i}" for i in range(60))
    made = [(i, good if i == 0 else "short", "en", "bad", 1) for i in range(100)] + [(100 + i, good, "en", "ok", 1) for i in range(100)]
    made += [(300, good, None, None, None)]
    df = spark.createDataFrame(made, COLUMNS).withColumnRenamed("lang", "rejected").withColumnRenamed("n_chars", "__n_words")
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(100, 200), 300}
    assert quality.filter_documents(empty).count() == 0


def test_language_learns_and_handles_odd_texts(spark, docs, empty):
    made, df = docs
    real = pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "text", "lang"]]
    train = spark.createDataFrame(real.iloc[::2])
    model = language.fit(train)
    assert model.langs == sorted(real["lang"].dropna().unique())
    found = language.predict(spark.createDataFrame(real.iloc[1::2]), model).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.95
    odd = {r["doc_id"]: r for r in language.predict(df.select("doc_id", "text"), model).collect()}
    for d, t, *_ in made:
        blank = not any(c.isalpha() for c in t or "")
        assert (odd[d]["lang_pred"] == "und") == blank and 0 <= odd[d]["score"] <= 1
    clash = df.select("doc_id", "text", df["lang"].alias("score"), df["source"].alias("has_letter"))
    assert language.predict(clash, model).columns == ["doc_id", "has_letter", "lang_pred", "score"]
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(df.select("doc_id", "text"), none).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_language_code_lengths_are_exact():
    """Against method C written out with dictionaries."""
    texts = {"a": [b"abracadabra", b"alakazam"], "b": [b"banana bandana"]}
    counts, trees = {}, {}
    for lang, ts in texts.items():
        tree = collections.defaultdict(collections.Counter)
        grams = collections.Counter()
        for t in ts:
            padded = b"\n\n\n" + t
            for i in range(3, len(padded)):
                grams[int.from_bytes(padded[i - 3 : i + 1], "big")] += 1
                for k in range(4):
                    tree[k, padded[i - k : i]][padded[i]] += 1
        trees[lang] = tree
        keys = sorted(grams)
        counts[lang] = (np.array(keys, np.uint32), np.array([grams[k] for k in keys], float))
    coder = language.Coder(language.freeze(["a", "b"], counts))

    def bits(lang, context, byte):
        for k in (3, 2, 1, 0):
            seen = trees[lang].get((k, context[3 - k :]))
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                return extra_of[0] - np.log2(seen[byte] / (total + kinds))
            extra_of[0] -= np.log2(kinds / (total + kinds))
        return extra_of[0] + 8

    for text in (b"abra", b"banana", b"zzz", b"a"):
        want = []
        for lang in ("a", "b"):
            padded, total = b"\n\n\n" + text, 0.0
            for i in range(3, len(padded)):
                extra_of = [0.0]
                total += bits(lang, padded[i - 3 : i], padded[i])
            want.append(total)
        got = coder.totals(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(got, want, atol=1e-3)


def test_packing_cuts_counts_and_fills(docs, empty):
    made, df = docs
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    got = packing.pack(df, queries.WORD_TOKENIZER).toPandas()
    want = []
    for d, t, *_ in made:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    have = [(None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.concatenate([[0], seq["length"].cumsum()[:-1]])).all() and seq["length"].sum() <= 2048
    assert packing.pack(empty, queries.WORD_TOKENIZER).count() == 0


@pytest.mark.parametrize("use", [lambda d: packing.pack(d, queries.WORD_TOKENIZER), jaccard.join_documents, quality.filter_documents])
def test_texts_go_to_python_in_short_batches(spark, use):
    """However many rows a partition has, at any time a task holds few of its texts."""
    spark.conf.unset(ARROW_ROWS)
    df = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "'h' AS source")
    use(df)
    sizes = df.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long").count()
    assert sizes >= 3
    spark.conf.set(ARROW_ROWS, "200")
    use(df)
    assert spark.conf.get(ARROW_ROWS) == "200"
    spark.conf.unset(ARROW_ROWS)


def test_packing_plans_are_whole_and_tight():
    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        histogram = {n: int(rng.integers(1, 50)) for n in range(1, capacity + 1) if rng.random() < 0.7}
        bins, placed = packing.plan_bins(histogram, capacity), collections.Counter()
        for b in bins:
            assert b.count > 0 and sum(n * k for n, k in b.runs) == b.used <= capacity
            assert sum(3 * n > capacity for n, k in b.runs for _ in range(k)) <= 2
            for n, k in b.runs:
                placed[n] += k * b.count
        assert placed == histogram
        total = sum(n * c for n, c in histogram.items())
        assert sum(b.count for b in bins) <= 11 / 9 * max(total / capacity, sum(c for n, c in histogram.items() if 2 * n > capacity)) + 2


def jaccard_by_hand(made):
    sets = {}
    for d, t, *_ in made:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.setdefault(d, set()).update({tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_join_on_odd_documents(docs, empty):
    made, df = docs
    made = [m for m in made if m[0] is not None]
    want = jaccard_by_hand(made)
    got = jaccard.join_documents(df.where("doc_id is not null")).collect()
    assert len(got) == len(made)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert jaccard.join_documents(df).count() == len(made) + 1
    one = jaccard.one_of_each(df)
    assert one.columns == df.columns
    left = [r["doc_id"] for r in one.where("doc_id is not null").collect()]
    assert sorted(set(left)) == sorted(d for d, (n, c) in want.items() if c == d) and len([x for x in left if want[x][0]]) == len({x for x in left if want[x][0]})
    assert jaccard.join_documents(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_jaccard_join_finds_links_around_a_leader(spark):
    """Many edited copies of a text, short and long ones, with links at and about the threshold."""
    rng = np.random.default_rng(5)
    made, d = [], 0
    for size in (5, 6, 7, 8, 10, 14, 25, 60, 150):
        base = [f"w{rng.integers(10**6)}" for _ in range(size + 3)]
        for _ in range(60):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, size // 20) * 2))):
                kind, at = rng.integers(3), int(rng.integers(len(own)))
                if kind == 0:
                    own[at] = f"w{rng.integers(40)}"
                elif kind == 1:
                    own.insert(at, f"w{rng.integers(40)}")
                else:
                    del own[at]
            d += 1
            made.append((int(rng.integers(10**9)) * 1000 + d, " ".join(own), None, None, None))
    df = keep(spark.createDataFrame(made, COLUMNS).repartition(4), "edited")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df).collect()}
    assert got == jaccard_by_hand(made)


def repeats_by_hand(made, length):
    w = [words(t) for _, t, *_ in made]
    times = collections.Counter(tuple(x[i : i + length]) for x in w for i in range(len(x) - length + 1))
    out = []
    for (d, *_), x in zip(made, w, strict=True):
        gone = {i + k for i in range(len(x) - length + 1) if times[tuple(x[i : i + length])] > 1 for k in range(length)}
        out.append((d, len(x), len(gone), hashlib.sha256(" ".join(v for i, v in enumerate(x) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("flush", [400_000, 50])
def test_repeats_on_odd_documents(docs, empty, flush):
    made, df = docs
    got = repeats.remove_repeats(df, flush=flush)
    digest = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr)
    assert digest == repeats_by_hand(made, 35)
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("flush", [400_000, 60])
def test_repeats_with_partial_overlaps(spark, flush):
    """Passages of many lengths, cut from a few texts and set between other words, with periodic ones among them."""
    rng = np.random.default_rng(3)
    pool = [[f"p{rng.integers(200)}" for _ in range(300)] for _ in range(3)] + [["a", "b", "c"] * 60, ["z"] * 120]
    made = []
    for d in range(150):
        own = []
        for _ in range(int(rng.integers(1, 5))):
            own += [f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 30)))]
            src = pool[int(rng.integers(len(pool)))]
            at, n = int(rng.integers(len(src))), int(rng.integers(5, 80))
            own += src[at : at + n]
        made.append((d, " ".join(own), None, None, None))
    got = repeats.remove_repeats(spark.createDataFrame(made, COLUMNS).repartition(5), flush=flush)
    digest = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr)
    assert digest == repeats_by_hand(made, 35)


def test_repeats_of_rows_that_come_many_times(spark):
    """Equal rows lose all long windows, texts that share a part with them lose that part, and short equal rows keep their words."""
    long, short = " ".join(f"q{i}" for i in range(300)), "a few words"
    made = [(1, long)] * 3000 + [(2, short)] * 50 + [(3, " ".join(["x", *(f"q{i}" for i in range(100, 160)), "y", "z"]))]
    made += [(4, " ".join(f"r{i}" for i in range(60))), (4, " ".join(f"s{i}" for i in range(60))), (None, long)]
    made = [(d, t, None, None, None) for d, t in made]
    got = repeats.remove_repeats(spark.createDataFrame(made, COLUMNS).repartition(5))
    digest = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr)
    assert digest == repeats_by_hand(made, 35)


def test_token_counts(docs, empty):
    made, df = docs
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    tok.encode_special_tokens = True
    got = token_counts.document_counts(df, queries.WORD_TOKENIZER, queries.END_OF_TEXT)
    want = sorted(((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in made), key=repr)
    assert rows(got, "doc_id", "n_tokens") == want
    assert token_counts.document_counts(empty, queries.WORD_TOKENIZER, queries.END_OF_TEXT).count() == 0


def test_token_scan_stitches_blocks_and_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    stream = rng.choice([7, 8, 9, 65535], 5000, p=[0.4, 0.35, 0.24, 0.01]).astype("<u2")
    cuts = [0, 1, 1300, 1301, 1303, 4000, 5000]
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        (tmp_path / f"part-{k:05d}.txt").write_bytes(stream[a:z].tobytes())
    ends = np.flatnonzero(stream == 65535)
    starts = np.concatenate([[0], ends + 1])
    want = [(int(s), int(e - s), True) for s, e in zip(starts[:-1], ends, strict=True)]
    if starts[-1] < len(stream):
        want.append((int(starts[-1]), int(len(stream) - starts[-1]), False))
    for block in (1, 64, 1 << 18):
        assert rows(token_counts.count_tokens(spark, str(tmp_path), 65535, block), "start", "n_tokens", "closed") == sorted(want, key=repr)


LABELS = "doc_id long, domain string"


def test_mixing_meets_targets(spark, docs, empty):
    rng = np.random.default_rng(2)
    vocabulary = {"x": [f"x{i}" for i in range(30)], "y": [f"y{i}" for i in range(30)]}
    made, labels = [], []
    for d in range(400):
        kind = "x" if d % 4 else "y"
        made.append((d, " ".join(rng.choice(vocabulary[kind], 40)), None, None, None))
        labels.append((d, kind))
    df, labelled = spark.createDataFrame(made, COLUMNS), spark.createDataFrame(labels, LABELS)
    rated, model = mixing.with_rates(df, labelled, {"x": 0.5, "y": 0.5})
    got = rated.selectExpr("doc_id", "__n", "__rate", "__copies").toPandas()
    tokens = got["__n"] * got["__rate"]
    assert abs(tokens[got["doc_id"] % 4 == 0].sum() / tokens.sum() - 0.5) < 0.01 and abs(tokens.sum() / got["__n"].sum() - 1) < 0.01
    assert (got["__copies"] - got["__rate"]).abs().max() < 1 and (got["__rate"] >= 0).all()
    odd = df.withColumnRenamed("lang", "__n").withColumnRenamed("source", "__rate")
    assert mixing.mix(odd, labelled, {"x": 0.5, "y": 0.5}).columns == odd.columns
    made, some = docs
    assert mixing.mix(some, spark.createDataFrame([], LABELS), {"x": 1.0}).count() == len(made)
    assert mixing.mix(empty, labelled, {"x": 1.0}).count() == 0
    assert mixing.with_rates(some, spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (3, "y"), (3, "y")], LABELS), {"x": 1.0})[0].count() == len(made)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, docs, empty):
    rng = np.random.default_rng(4)
    cards = []
    while len(cards) < 40:
        c = "".join(map(str, rng.integers(0, 10, 16)))
        cards.append(c)
    texts = [f"pay {c} now" for c in cards] + [f"again {cards[0]}, {cards[0]}!"]
    ips = [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(60)]
    texts += [f"at {x} there" for x in ips] + ["1.2.3.256 and 01.2.3.4 stay"]
    days = [str(np.datetime64("1700-01-01") + int(x)) for x in rng.integers(0, 146097, 60)]
    texts += [f"on {x}" for x in days] + ["on 2023-02-29 and 1699-12-31", "am 29.02.2024."]
    texts += ['token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "mail und.34@mail7.example.com, x@y.org", "+1 (974) 555-3436 or 555-123-4567", "DE89370400440532013000 not DE88370400440532013000"]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], COLUMNS)
    out = pii.pseudonymize(df, "key", changed="n_replaced")
    assert out.columns == [*df.columns, "n_replaced"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(t) and re.sub("[0-9]", "9", re.sub("[a-z]", "a", got[i])) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", t))
    new = {c: got[i].split()[1] for i, c in enumerate(cards)}
    for c, n in new.items():
        assert (n != c and luhn(n)) if luhn(c) else n == c
    assert got[40] == f"again {new[cards[0]]}, {new[cards[0]]}!"
    moved = [got[41 + i].split()[1] for i in range(60)]
    assert len(set(moved)) == len(set(ips)) and all(max(map(int, x.split("."))) < 256 for x in moved) and sum(a == b for a, b in zip(ips, moved, strict=True)) < 3
    assert got[101] == texts[101] and got[162] == texts[162]
    new_days = [got[102 + i].split()[1] for i in range(60)]
    assert len(set(new_days)) == len(set(days)) and all(str(np.datetime64(x)) == x for x in new_days)
    assert "mail7" not in got[165] and got[165].endswith(".org") and "555-3436" not in got[166]
    iban, same = got[167].split()[0], got[167].split()[2]
    number = int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))
    assert number % 97 == 1 and iban != "DE89370400440532013000" and same == "DE88370400440532013000"
    made, some = docs
    assert pii.pseudonymize(some.withColumnRenamed("lang", "__found"), "key").columns[2] == "__found"
    plain = [t for _, t, *_ in made if not re.search(r"[0-9@=]", t or "")]
    kept = collections.Counter(r["text"] for r in pii.pseudonymize(some, "key").collect())
    assert all(kept[t] >= n for t, n in collections.Counter(plain).items())
    assert pii.pseudonymize(empty, "key").count() == 0


def test_feistel_on_addresses_is_a_permutation(spark):
    """All addresses of one short form, each another one's pseudonym."""
    df = spark.range(10000).selectExpr("id AS doc_id", "concat_ws('.', id div 1000, id div 100 % 10, id div 10 % 10, id % 10) AS text")
    assert pii.pseudonymize(df, "key").select("text").distinct().intersect(df.select("text")).count() == 10000


def test_equal_sets_have_one_speaker(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLASS_PART", 20)
    made = [(1000 - i, "a b c d e" if i % 2 else f"x{i % 10} b c d e", None, None, None) for i in range(200)] + [(5, "", None, None, None), (3, None, None, None, None)]
    got = {r["doc_id"]: r["rep"] for r in jaccard.with_classes(keep(jaccard.set_table(spark.createDataFrame(made, COLUMNS).select("doc_id", "text")), "t")).collect()}
    least = {}
    for d, t, *_ in made:
        least[t] = min(d, least.get(t, d))
    assert got == {d: least[t] if t else None for d, t, *_ in made}


@pytest.mark.parametrize("flush", [600_000, 40])
def test_jaccard_join_whatever_the_blocks(spark, flush):
    """A chain of texts, each like its neighbours only, in many blocks: what one block groups must meet all others."""
    rng = np.random.default_rng(11)
    made, base = [], [f"w{i}" for i in range(120)]
    for step in range(60):
        base = list(base)
        for _ in range(int(rng.integers(1, 3))):
            base[int(rng.integers(len(base)))] = f"n{rng.integers(10**6)}"
        made.append((int(rng.integers(10**12)), " ".join(base), None, None, None))
        if step % 7 == 0:
            made.append((int(rng.integers(10**12)), " ".join(base), None, None, None))
    df = keep(spark.createDataFrame(made, COLUMNS).repartition(6), "chain")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df, flush=flush).collect()}
    assert got == jaccard_by_hand(made)


def test_copies_meet_leaders_as_one(spark, monkeypatch):
    """Two linked texts, 300 copies of each, in four blocks: groups bring their leaders back to classes, not to each copy."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base), " ".join(["n0", *base[1:]])]
    df = keep(spark.createDataFrame([(d, texts[d % 2], None, None, None) for d in range(600)], COLUMNS).repartition(4), "copies")
    brought, join = [], type(df).join

    def seen(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "number":
            brought.append(out)
        return out

    monkeypatch.setattr(type(df), "join", seen)
    got = jaccard.join_documents(df).collect()
    assert len(got) == 600 and {r["component_id"] for r in got} == {0}
    assert len(brought) == 1 and brought[0].count() <= 16


def test_only_texts_that_may_be_linked_are_compared(spark, monkeypatch):
    """Texts that share two thirds meet by their signatures and are linked with none; only three of them have near copies."""
    rng = np.random.default_rng(17)
    shared = [f"s{i}" for i in range(120)]
    texts = [[*shared, *(f"d{d}x{i}" for i in range(int(rng.integers(50, 70))))] for d in range(50)]
    made = [(d, " ".join(t), None, None, None) for d, t in enumerate(texts)]
    made += [(100 + d, " ".join([*texts[d], "more"]), None, None, None) for d in (7, 20, 33)]
    met, left = [], []
    monkeypatch.setattr(jaccard, "leader_pairs", lambda *a, f=jaccard.leader_pairs: met.append(f(*a)) or met[-1])
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *a, f=jaccard.verify: left.append(pairs) or f(pairs, *a))
    df = keep(spark.createDataFrame(made, COLUMNS).repartition(4), "shared")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df).collect()}
    assert got == jaccard_by_hand(made)
    assert met[0].count() >= 100 and {r["b"] for r in left[0].collect()} <= {7, 20, 33, 107, 120, 133}
    sets = keep(jaccard.set_table(df.select("doc_id", "text")), "sets")
    whole = sorted(map(tuple, jaccard.with_partners(met[0], sets).collect()))
    monkeypatch.setattr(jaccard, "PARITY_BLOCK", 5)
    assert whole and sorted(map(tuple, jaccard.with_partners(met[0], sets).collect())) == whole


def test_parities_leave_no_link_out():
    """Rows of parities differ in no more bits than their sets in elements, at any size, also across their widths."""
    rng = np.random.default_rng(23)
    made = [np.zeros(0, np.uint64)]
    for size in (1, 2, 5, 30, 62, 66, 125, 130, 500, 1020, 1030):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.15, 0.3, 0.6):
            kept = base[rng.random(size) >= share]
            made.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.binomial(size, share)).astype(np.uint64)])))
    sizes = np.array([len(x) for x in made])
    sets = shingles.Sets(np.concatenate(made), np.concatenate([[0], np.cumsum(sizes)]))
    rows = shingles.parities(sets)
    assert [len(r) for r in rows[:1]] == [0] and all(8 * len(r) >= max(64, n) for r, n in zip(rows[1:], sizes[1:], strict=True) if n)
    for percent in (40, 80, 85):
        linked = np.zeros(len(made), bool)
        for i, x in enumerate(made):
            for j, y in enumerate(made):
                common = len(np.intersect1d(x, y))
                linked[i] |= i != j and common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
        found = shingles.with_partner(sizes, rows, np.arange(len(made)), percent)
        assert linked.sum() > 20 and not (linked & ~found).any() and (percent < 80 or found.sum() <= 1.3 * linked.sum())
        assert not shingles.with_partner(sizes, rows, np.zeros(len(made), int), percent).any()


def test_mixing_learns_from_many_rare_words_and_not_from_copies(spark):
    """Forty insults at 7 % each tell; the words of 150 near copies and single ones don't."""
    rng = np.random.default_rng(8)
    made, labels = [], []
    template = [f"t{i}" for i in range(80)]
    for d in range(1600):
        kind = "toxic" if d % 4 == 0 else "good"
        own = [f"w{x}" for x in rng.integers(0, 3000, 60)] + [f"once{d}"]
        if kind == "toxic":
            own += [f"insult{i}" for i in range(40) if rng.random() < 0.07]
        made.append((d, " ".join(own), None, None, None))
        labels.append((d, kind))
    for d in range(2000, 2150):
        made.append((d, " ".join([*template, f"copy{d}"]), None, None, None))
        labels.append((d, "toxic"))
    df, labelled = spark.createDataFrame(made, COLUMNS), spark.createDataFrame(labels, LABELS)
    model = mixing.fit(labelled, df)
    assert model.domains == ["good", "toxic"] and round(np.exp(model.priors[0]), 2) == round(1200 / 1601, 2)
    got = mixing.score(df, model).selectExpr("doc_id", "text", "__p[1] AS p").toPandas()
    insulted = got["text"].str.contains("insult")
    assert insulted.sum() > 300 and got["p"][insulted].min() > 0.5 and (got["p"][insulted] > 0.9).mean() > 0.8
    assert got["p"][~insulted & (got["doc_id"] < 2000)].max() < 0.5 and got["p"][got["doc_id"] >= 2000].max() < 0.5


def test_near_classes_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 10**6, int(rng.integers(1, 60))).tolist()
        for _ in range(8):
            sets.append(sorted({x if rng.random() > 0.08 else int(rng.integers(0, 10**6)) for x in base}))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = dict(rows(mixing.near_classes(keep(spark.createDataFrame(list(enumerate(sets)), "node long, set array<bigint>"), "near-test"))))
    assert len(got) > 10 and all(got.get(i, i) == find(i) for i in range(len(sets)))


@pytest.mark.parametrize("target", [(0.5, 0.3, 0.2), (0.93, 0.05, 0.02), (0.2, 0.2, 0.6)])
def test_mixing_meets_targets_on_overlapping_domains(spark, target):
    rng = np.random.default_rng(6)
    p = np.exp(rng.normal(size=(5000, 3)) * 1.5 + np.log([0.8, 0.14, 0.06]))
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 900, 5000).astype(float)
    scored = keep(spark.createDataFrame(pd.DataFrame({"doc_id": range(5000), "__n": n, "__p": p.tolist()})), "soft")
    numbers, gaps = mixing.solve(scored, mixing.Classifier(["x", "y", "z"], [0.0] * 3, [], [0], []), dict(zip("xyz", target, strict=True)))
    rates = scored.select("doc_id", mixing.rate(numbers).alias("r")).toPandas().set_index("doc_id")["r"].sort_index().to_numpy()
    reached = (n * rates) @ p / n.sum()
    assert np.allclose(reached, target, atol=1e-5) and rates.min() >= 0
    assert np.allclose([gaps[d] for d in "xyz"], reached - target, atol=1e-9)


def test_mixing_reports_targets_out_of_reach(spark):
    """Every document half x and half y: the nearest is half of the tokens each, whatever is wanted."""
    scored = keep(spark.range(100).selectExpr("id AS doc_id", "10D AS __n", "array(0.5D, 0.5D) AS __p"), "halves")
    with pytest.warns(UserWarning, match="misses its targets"):
        numbers, gaps = mixing.solve(scored, mixing.Classifier(["x", "y"], [0.0] * 2, [], [0], []), {"x": 0.9, "y": 0.1})
    assert abs(gaps["x"] + 0.4) < 1e-4 and abs(gaps["y"] - 0.4) < 1e-4
    assert abs(scored.select(mixing.rate(numbers).alias("r")).first()["r"] - 1) < 1e-4


@pytest.mark.parametrize("bad", [4, 200])
def test_mixing_keeps_a_whole_domain_at_any_composition(spark, bad):
    """Good documents over and under their weight: none is dropped, and the domains' shares are as wanted."""
    rng = np.random.default_rng(7)
    made, labels = [], []
    for d in range(800):
        kind = "poor" if d < bad else "good"
        made.append((d, " ".join([f"w{x}" for x in rng.integers(0, 400, 30)] + [f"bad{x}" for x in range(12) if kind == "poor"]), None, None, None))
        labels.append((d, kind))
    for d in range(1000, 1040):  # labelled ones that have other words
        made.append((d, " ".join([f"v{x}" for x in rng.integers(0, 400, 3)] + [f"bad{x}" for x in range(12)]), None, None, None))
        labels.append((d, "poor"))
    df, labelled = spark.createDataFrame(made, COLUMNS), spark.createDataFrame(labels, LABELS)
    some = df.where("doc_id < 1000")
    rated, model = mixing.with_rates(df, labelled, {"good": 0.93, "poor": 0.07}, whole="good")
    got = rated.selectExpr("doc_id", "__n", "__p", "__rate", "__copies").toPandas()
    good = got["doc_id"].between(bad, 799)
    assert got["__rate"][good].min() >= 1 and got["__copies"][good].min() >= 1
    expected = np.array(got["__p"].tolist()).T @ (got["__n"] * got["__rate"]).to_numpy()
    assert abs(expected[model.domains.index("good")] / expected.sum() - 0.93) < 1e-3
    kept = {r["doc_id"] for r in mixing.mix(some, labelled, {"good": 0.93, "poor": 0.07}, whole="good").select("doc_id").collect()}
    assert kept >= set(range(bad, 800))


def mixing_by_hand(docs, domain_of, target):
    """Rates by plain dictionaries and by projections onto the totals and onto rates of 0 and more, one after the other."""
    present = {d: set(t.lower().split()) for d, t in docs}
    size = collections.Counter(domain_of.values())
    domains = sorted(size, key=lambda k: (-size[k], k))
    count = {k: collections.Counter(w for d in domain_of if domain_of[d] == k for w in present[d]) for k in domains}
    n_0, first = size[domains[0]], count[domains[0]]
    prior, odds = {k: np.log(size[k] / len(domain_of)) for k in domains}, {k: {} for k in domains}
    for k in domains[1:]:
        absent = 0.0
        for w in set(count[k]) | set(first):
            a, b = count[k][w], first[w]
            own, other, pooled = (a + 0.5) / (size[k] + 1), (b + 0.5) / (n_0 + 1), (a + b + 0.5) / (size[k] + n_0 + 1)
            spread = np.sqrt(pooled * (1 - pooled) * (1 / size[k] + 1 / n_0))
            cells = [(a, a + b, size[k]), (b, a + b, n_0), (size[k] - a, size[k] + n_0 - a - b, size[k]), (n_0 - b, size[k] + n_0 - a - b, n_0)]
            ratio = 2 * sum(x * np.log(x * (size[k] + n_0) / (of * whole)) for x, whole, of in cells if x)
            gone = np.log((1 - own) / (1 - other))
            if abs(np.log(own / other)) >= mixing.LEAST_ODDS and abs(own - other) >= mixing.LEAST_SPREADS * spread and ratio >= mixing.LEAST_SPREADS**2:
                odds[k][w] = np.log(own / other) - gone
                absent += gone if own > other else 0.0
        prior[k] += max(-mixing.ABSENT, absent)
    told = set().union(*odds.values())
    log = np.array([[prior[k] + sum(odds[k].get(w, 0.0) for w in present[d] & told) for k in domains] for d, _ in docs])
    p = np.exp(log - log.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    n = np.array([float(len(t.split())) for _, t in docs])
    want = np.array([target[k] for k in domains]) * n.sum()
    moved, rate = np.ones(len(n)), np.ones(len(n))
    for _ in range(20_000):
        moved = moved - p @ (((n * rate) @ p - want) / (n @ p))
        rate = np.maximum(0, moved)
    return domains, p, rate


def test_words_that_share_a_slot_all_tell(spark):
    hashes = sorted([r[0] for r in spark.range(12).selectExpr("xxhash64(concat('w', id))").collect()], key=lambda h: (h % 2, h))
    first = sum(h % 2 == 0 for h in hashes)
    odds = [float(k + 1) for k in range(12)]
    model = mixing.Classifier(["a", "b"], [0.0, 0.0], hashes, [0, first, 12], [odds])
    logs = spark.range(12).select(model.logs(F.array(F.expr("xxhash64(concat('w', id))"), F.lit(5).cast("long")))[1].alias("x"))
    assert sorted(r["x"] for r in logs.collect()) == odds


def test_mixing_hashes_and_looks_up_each_word_once(spark, docs):
    """However many domains there are; words at any space, telling ones with a slot of their own or shared."""
    made, some = docs
    told = ["a", "b", "c", "nothing", "é,è;é!!", "x"]
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in told], "w string").selectExpr("xxhash64(w)").collect()]
    ordered = sorted(zip(hashes, told, strict=True), key=lambda x: (x[0] % 3, x[0]))
    begins = [sum(h % 3 < slot for h, _ in ordered) for slot in range(4)]
    odds = [[k + 1.0 for k in range(6)], [10.0**k for k in range(6)]]
    model = mixing.Classifier(["p", "q", "r"], [-1.0, -2.0, -3.0], [h for h, _ in ordered], begins, odds)
    scored = mixing.score(some, model)
    assert str(scored._jdf.queryExecution().optimizedPlan()).count("xxhash64") == 1
    for r in scored.select("text", "__n", "__p").collect():
        found = WORD.findall((r["text"] or "").lower())
        logs = np.array([-1.0, *(p + sum(o[k] for k, (_, w) in enumerate(ordered) if w in found) for p, o in zip((-2.0, -3.0), odds, strict=True))])
        p = np.exp(logs - logs.max())
        assert r["__n"] == len(found) and np.allclose(r["__p"], p / p.sum())


def test_mixing_equals_a_plain_version(spark):
    """Posteriors and rates of documents in three overlapping domains."""
    rng = np.random.default_rng(11)
    docs, domain_of = [], {}
    for d in range(900):
        kind = "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        own = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(5, 60)))] + [f"once{d}"]
        for k in "abc":
            own += [f"{k}{x}" for x in rng.integers(0, 25, 4 if k == kind else int(rng.integers(0, 2)))]
        docs.append((d, " ".join(own)))
        if d % 3:
            domain_of[d] = kind
    target = {"a": 0.4, "b": 0.25, "c": 0.35}
    domains, p, want = mixing_by_hand(docs, domain_of, target)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], COLUMNS)
    rated, model = mixing.with_rates(df, spark.createDataFrame(list(domain_of.items()), LABELS), target)
    got = rated.selectExpr("doc_id", "__p", "__rate").toPandas().set_index("doc_id").sort_index()
    assert model.domains == domains and max(map(abs, model.gaps.values())) < 1e-4 and len(model.words) > 20
    assert np.allclose(np.array(got["__p"].tolist()), p, atol=1e-4) and (p.max(axis=1) < 0.99).sum() > 5
    assert np.allclose(got["__rate"], want, atol=1e-3) and np.ptp(want) > 0.5
