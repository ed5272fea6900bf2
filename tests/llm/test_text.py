"""Token counts, packing, decontamination and line dedup against plain versions."""

import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from habitatrix.llm import chunked, decontaminate, line_dedup, packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "doc_id bigint, text string"

ODD = ["", " ", "  a", "a  b   c ", "a\n b", "x<|endoftext|>y z", "é ü  z", "　 a", "<s> </s> a", "▁ ▁x", "x ▁ y", "日本 語", "a ", "   b"]


def batch(texts):
    import pyarrow as pa

    from habitatrix.llm.tables import texts_of

    part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return texts_of(part, "text")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet="ab .,'▁é\n\t 日1", max_size=40)), min_size=1, max_size=5))
def test_chunks_give_the_librarys_tokens(texts):
    counter, encoder = chunked.opened(chunked.PieceCounter, PIECES), chunked.opened(chunked.ByteEncoder, BYTES)
    assert counter.by_chunk
    assert counter.counts(texts, *batch(texts)).tolist() == [len(x) for x in counter.model.encode(texts)]
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    got = [list(memoryview(x).cast("I")) for x in encoder.encode(texts, *batch(texts))]
    assert got == want


def test_chunk_table_starts_anew_when_full():
    import numpy as np

    table = chunked.ChunkTable(lambda chunks: np.array([len(c) for c in chunks], dtype="int64"), limit=20)
    for k in range(6):
        texts = [f"w{k}{i} v{i}" for i in range(9)]
        values, starts = table.look_up(*batch(texts))
        ends = np.append(starts[1:], len(batch(texts)[0]))
        assert values.tolist() == (ends - starts).tolist()


def test_token_counts_and_cache(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None, "a b", "a b"])] + [(1, "other", 2), (None, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    model = chunked.opened(chunked.PieceCounter, PIECES).model
    for _ in range(2):
        got = token_counts.count_tokens(docs, PIECES, cache).collect()
        want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in rows)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.dropDuplicates(["digest"]).count() == len({t or "" for _, t, _ in rows})
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_token_counts_of_an_id_with_a_copy_and_another_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y z")], TEXT)
    model = chunked.opened(chunked.PieceCounter, PIECES).model
    for _ in range(2):
        got = token_counts.count_tokens(docs, PIECES, str(tmp_path / "cache")).collect()
        want = [(1, len(model.encode("x"))), (2, len(model.encode("x"))), (2, len(model.encode("y z")))]
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(want)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rng.choice([0, 3, 40, 90, 150, 400])))) for i in range(60)]
    rows += [(100, None), (100, None), (101, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, TEXT)
    got = packing.pack(docs, BYTES, capacity=128, shard_pieces=1000).collect()
    library = chunked.opened(chunked.ByteEncoder, BYTES).library
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids) % 128 or min(len(ids), 128), len(ids) + 1, 128))
        for k, (a, b) in enumerate(itertools.pairwise([0, *cuts])):
            want.append((str(i), k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(placed) <= -(-total // 128) * 1.05 + 1
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_sum_of_squares_fills_bins():
    import numpy as np

    sizes = np.random.default_rng(4).integers(1, 2049, 3000)
    bins, offsets = packing.sum_of_squares(sizes, 2048)
    used = np.bincount(bins, sizes)
    assert used.max() <= 2048
    assert len(used) <= 1.03 * sizes.sum() / 2048 + 1
    assert (offsets + sizes <= 2048).all()


def test_masks_miss_no_window():
    for window in range(decontaminate.SPAN, decontaminate.OVERLAP + 1):
        for bad in itertools.combinations(range(window), decontaminate.allowed(window)):
            hit = any(
                all(m[b - s] == "0" for b in bad if 0 <= b - s < len(m))
                for m in decontaminate.MASKS
                for s in range(window - len(m) + 1)
            )
            assert hit, (window, bad)


def contaminated(rows, items):
    def tokens(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())

    out = {}
    for doc, text in rows:
        x = tokens(text)
        for item, wanted in items:
            y = tokens(wanted)
            w = min(decontaminate.OVERLAP, len(y))
            counts = [
                sum(x[i + k] == y[j + k] for k in range(w))
                for i in range(len(x) - w + 1)
                for j in range(len(y) - w + 1)
                if w
            ]
            good = [c for c in counts if c >= w - decontaminate.allowed(w)]
            if good:
                out[doc, item] = (len(good), max(good))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(n)]) for i, n in enumerate([40, 25, 13, 12, 11, 9, 4, 60])]
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        part = list(rng.choice(items)[1])
        part = part[rng.randint(0, 3) :]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "Changed"
        rows.append((i, " ".join(words[:20] + part + words[20:]).title() + "."))
    rows += [(200, None), (201, ""), (202, "t1 " * 500)]
    bench = [(i, ", ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "t1 " * 30)]
    docs, items_df = spark.createDataFrame(rows, TEXT), spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontaminate.overlaps(docs, items_df).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in got} == contaminated(rows, bench)
    bad = {r.doc_id for r in got}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items_df).collect()) == sorted({i for i, _ in rows} - bad)
    assert decontaminate.overlaps(docs.limit(0), items_df).count() == 0
    assert decontaminate.overlaps(docs, items_df.limit(0)).count() == 0


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fingerprint(spark, texts):
    rows = [(1, k, t) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id bigint, line int, norm string")
    lines = lines.selectExpr("*", "xxhash64(norm) h1", "xxhash64('second', norm) h2")
    return {r.line: r.sim for r in line_dedup._fingerprints(lines).collect()}


def test_line_dedup(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}x" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(25)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ".join(words), "  ".join(words).upper() + "!", "", "two words", "--"]))
        rows.append((i * 7 % 53, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[3][1]), (204, " ".join(base[0] * 50))]
    places = [(d, k, norm(x)) for d, t in sorted(rows, key=lambda r: r[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    texts = sorted({t for _, _, t in places if len(t.split()) >= 3})
    prints = fingerprint(spark, texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            x, y = texts[a], texts[b]
            if edit_distance(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9):
                parent[find(a)] = find(b)
    index, kept, first = {t: i for i, t in enumerate(texts)}, set(), set()
    for d, k, t in places:
        group = find(index[t]) if t in index else None
        if group is None or group not in first:
            kept.add((d, k))
            first.add(group)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        if t is None:
            assert got[d].text is None and (got[d].n_lines, got[d].n_removed) == (0, 0)
            continue
        lines = t.split("\n")
        stays = [x for k, x in enumerate(lines) if (d, k) in kept]
        assert got[d].text == "\n".join(stays)
        assert (got[d].n_lines, got[d].n_removed) == (len(lines), len(lines) - len(stays))
    assert len({find(i) for i in range(len(texts))}) < len(texts), "no fuzzy link was tried"
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300])
def test_fingerprints_are_majorities(spark, n):
    rng = random.Random(n)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    words = spark.createDataFrame([(w,) for w in text.split()], "w string").selectExpr("xxhash64(w) x").collect()
    want = sum(1 << b for b in range(63) if 2 * sum((r.x >> b) & 1 for r in words) > n)
    assert fingerprint(spark, [text])[0] == want


def planted(rng, n, change):
    """A line of n words, and a copy with one other letter or word, or with letters changed up to the limit."""
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    line, other = " ".join(words), list(words)
    if change == "word":
        k = rng.randrange(n)
        other[k] = "".join(rng.choice("uvwxyz") for _ in words[k])
    letters = list(" ".join(other))
    if change != "word":
        at = [i for i, c in enumerate(letters) if c != " "]
        for i in rng.sample(at, 1 if change == "letter" else max(1, len(letters) // 20)):
            letters[i] = "z"
    copy = "".join(letters)
    return (line, copy) if edit_distance(line, copy) <= int(0.1 * len(line) + 1e-9) else planted(rng, n, change)


def test_line_dedup_recall_by_edit_distance_alone(spark):
    rng = random.Random(11)
    kinds = [(n, c) for n in (5, 10, 20, 50) for c in ("letter", "word", "letters")]
    rows, kind_of = [], {}
    for kind in kinds:
        for _ in range(60):
            for line in planted(rng, *kind):
                rows.append((len(rows), line))
            kind_of[len(rows) - 1] = kind
    got = line_dedup.deduplicate(spark.createDataFrame(rows, TEXT), line_dedup.WHOLE).collect()
    gone = {r.doc_id for r in got if r.n_removed}
    assert gone <= set(kind_of), "a line without a copy before it was removed"
    recall = {k: sum(i in gone for i in kind_of if kind_of[i] == k) / 60 for k in kinds}
    print(recall)
    assert all(v >= (0.9 if c == "letters" else 0.97) for (_, c), v in recall.items()), recall


def test_line_dedup_without_blanks(spark):
    rng = random.Random(12)

    def signs(first, n):
        return "".join(chr(first + rng.randrange(300)) for _ in range(n))

    han, long_han = signs(0x4E00, 13), signs(0x5E00, 80)
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(40))
    latin = "".join(rng.choice("abcdefgh") for _ in range(60))
    pairs = [
        (han, han),
        (long_han, long_han[:40] + "\u4e8c" + long_han[41:]),
        (thai, thai[:-1] + "\u0e2e"),
        (latin, latin[:30] + "z" + latin[31:]),
        ("one\u3000two\u00a0three four", "one two, three\u3002four"),
        ("unsubscribe immediately", "Unsubscribe immediately"),
    ]
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    rows += [(50, "two words"), (51, "two words"), (52, "\u4e8c\u4e09"), (53, "\u4e8c\u4e09")]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, TEXT), line_dedup.WHOLE).collect()
    assert {r.doc_id for r in got if r.n_removed} == {2 * i + 1 for i in range(len(pairs))}


def test_line_dedup_bands_in_steps_are_all_bands(spark):
    """Each step has its own keys, so that no pair is lost or met twice."""
    texts = ["one two three four", " ".join(f"w{i}" for i in range(15)), " ".join(f"w{i}" for i in range(30))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], TEXT)
    lines = line_dedup._lines(docs, line_dedup.WHOLE)
    sketches = line_dedup._sketches(lines).cache()
    whole = sorted(tuple(r) for r in line_dedup._bands(sketches).collect())
    steps = [{tuple(r) for r in line_dedup._bands(sketches, k, line_dedup.STEPS).collect()} for k in range(line_dedup.STEPS)]
    assert all(steps) and sorted(r for step in steps for r in step) == whole
    keys = [{r[2] for r in step} for step in steps]
    assert sum(map(len, keys)) == len(set().union(*keys))


def test_line_tokens_are_made_once(spark):
    """The optimizer adds no test of the tokens below the generator, which would make them twice."""
    docs = spark.createDataFrame([(1, "one two three\nfour five six seven eight nine ten")], "doc_id bigint, text string")
    sketches = line_dedup._sketches(line_dedup._lines(docs, line_dedup.WHOLE).where("h1 IS NOT NULL"))
    plan = sketches._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sketches.count() == 3  # trigrams of the short line, trigrams and words of the one of seven


def test_lines_compared_word_by_word_first_link_as_by_edit_distance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(60)]
    pairs = []
    for n in (3, 15, 16, 40, 90):
        for share in (0.0, 0.02, 0.08, 0.1, 0.12, 0.3):
            x = rng.choices(words, k=n)
            y = [rng.choice(words) if rng.random() < share else w for w in x]
            letters = [rng.choice("xyz") if c != " " and rng.random() < share / 2 else c for c in " ".join(x)]
            moved = y[1:] + y[:1]
            pairs += [(" ".join(x), z) for z in (" ".join(y), "".join(letters), " ".join(y[1:]), " ".join(moved), f"{y[0]}q {' '.join(y)}")]
    texts = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "node bigint, norm string")
    both = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a bigint, b bigint")
    got = {r.a // 2 for r in line_dedup._similar(both, texts, line_dedup.WHOLE).collect()}
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    most = F.floor(0.1 * F.greatest(F.length("x"), F.length("y")) + 1e-9).cast("int")
    rows = frame.withColumn("most", most).select("i", "most", F.levenshtein("x", "y").alias("d"), F.expr(line_dedup._BY_WORDS).alias("by_words"))
    rows = rows.where(F.size(F.split("x", " ")) == F.size(F.split("y", " "))).collect()
    assert all(r.by_words >= min(r.d, r.most + 1) for r in rows)
    proved = {r.i for r in rows if r.by_words <= r.most}
    plain = {r.i for r in frame.where(F.levenshtein("x", "y") <= most).collect()}
    assert got == plain and proved <= plain and len(proved) >= len(plain) / 3 > 10


def test_line_steps_release_their_shuffle_files(spark, monkeypatch):
    done = []
    write, free = line_dedup.materialize, line_dedup.release
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: (done.append(label), write(df, label))[1])
    monkeypatch.setattr(line_dedup, "release", lambda session: (done.append("release"), free(session)))
    lines = ["one two three four five six seven", "one two three four five six sevem", "one two three four five six seven eight nine ten"]
    docs = spark.createDataFrame(list(enumerate(lines)), TEXT)
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate(docs, line_dedup.WHOLE).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    large = {"line-pairs", "line-texts", "line-links", "line-roots", "line-rest"}
    assert large <= set(done)
    assert all(done[i + 1] == "release" for i, label in enumerate(done) if label in large)


def test_counts_of_characters_drop_no_pair_within_the_distance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    texts = []
    for n in (20, 60, 120, 255, 256, 400):
        for edits in (0.02, 0.05, 0.1, 0.11, 0.3, None):
            for _ in range(6):
                x = "".join(rng.choices(" eanitroshlducmxyz\u00e9\u4e00", k=n))
                y = "".join(rng.choices(" eanitroshlducm", k=n)) if edits is None else x
                for _ in range(int((edits or 0) * n)):
                    at = rng.randrange(len(y))
                    y = y[:at] + rng.choice(["", rng.choice("eatz q"), y[at] + rng.choice("eatz q")]) + y[at + 1 :]
                texts.append((x, y))
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, x string, y string")
    longest = F.greatest(F.length("x"), F.length("y"))
    found = frame.select("i", "x", "y", (F.levenshtein("x", "y") <= F.floor(0.1 * longest + 1e-9)).alias("near"))
    for end in ("x", "y"):
        counted = line_dedup._counts(frame.select("i", F.col(end).alias("norm"), F.length(end).alias("size")))
        found = found.join(counted.select("i", *[F.col(c).alias(c + end) for c in ("size", "lo", "hi")]), "i")
    found = found.withColumn("alike", line_dedup._alike("x", "y", F.greatest("sizex", "sizey"), line_dedup.WHOLE)).collect()
    assert len(found) == len(texts) and all(r.alike for r in found if r.near)
    assert sum(r.near for r in found) > 60
    short = [r for r in found if len(r.x) <= 200 and r.i // 6 % 6 == 5]
    assert not any(r.alike for r in short)
    assert all(r.alike for r in found if max(len(r.x), len(r.y)) > line_dedup.COUNTED_CHARS)


def test_chance_partners_go_before_texts_are_fetched(spark, monkeypatch):
    """Short lines that share a few words meet in bands, far more often in larger tables."""
    rng = random.Random(13)
    words = ["".join(rng.choices("bcdfghklmnprstvwaeiou", k=rng.randint(4, 8))) for _ in range(40)]
    lines = [" ".join(rng.choices(words, k=10)) for _ in range(600)]
    lines += [line.replace(" ", "  x", 1) for line in lines[:20]]
    rows = {}
    write = line_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), TEXT)
    got = {r.doc_id for r in line_dedup.deduplicate(docs, line_dedup.WHOLE).collect() if r.n_removed}
    assert got == set(range(600, 620))
    assert rows["line-blocks"] > 3000
    assert rows["line-pairs"] + rows["line-rest"] < rows["line-blocks"] / 10


def test_line_tables_go_when_nothing_reads_them_again(spark):
    import pathlib

    from habitatrix.session import discard, materialize, session_scratch

    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six sevem")], TEXT)
    folder = pathlib.Path(session_scratch(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("line-*")}
    assert line_dedup.deduplicate(docs, line_dedup.WHOLE).collect()
    labels = {p.name.rsplit("-", 1)[0] for p in folder.glob("line-*") if p.name not in before}
    assert "line-flags" in labels and not labels & {"line-sketches", "line-blocks", "line-roots"}
    mine, other = materialize(docs, "one"), materialize(docs, "two")
    outside = folder.parent / "outside"
    docs.write.parquet(str(outside))
    discard(mine, spark.read.parquet(str(outside)))
    assert not pathlib.Path(mine.inputFiles()[0].removeprefix("file://")).exists()
    assert other.count() == spark.read.parquet(str(outside)).count() == 2


def test_batches_of_wide_rows_are_bounded(spark):
    import pyarrow as pa

    from habitatrix.llm import tables

    tables.ship(spark)
    wide = spark.range(0, 2_000, 1, 1).selectExpr("id", "repeat(string(id % 10), 20000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = wide.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 2_000
    assert max(r["bytes"] for r in got) <= 1.1 * tables.BATCH_BYTES


def test_counts_of_long_lines_drop_chance_partners_only(spark):
    from pyspark.sql import functions as F

    rng = random.Random(14)
    texts = []
    for n in (250, 256, 300, 500, 1200, 70_000):
        for edits in (0.0, 0.05, 0.1, 0.2, None):
            x = "".join(rng.choices(" eanitroshlducmxyzé一", k=n))
            y = "".join(rng.choices(" eanitz", k=n)) if edits is None else x
            for _ in range(int((edits or 0) * min(n, 1200))):
                at = rng.randrange(len(y))
                y = y[:at] + rng.choice(["", rng.choice("eatz q"), y[at] + rng.choice("eatz q")]) + y[at + 1 :]
            texts.append((x, y))
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, x string, y string")
    longest = F.greatest(F.length("x"), F.length("y"))
    found = frame.select("i", "x", "y", F.levenshtein("x", "y", 130).between(0, F.floor(0.1 * longest + 1e-9)).alias("near"))
    for end in ("x", "y"):
        counted = line_dedup._spread(line_dedup._counts(frame.select("i", F.col(end).alias("norm"), F.length(end).alias("size"))))
        found = found.join(counted.select("i", *[F.col(c).alias(c + end) for c in counted.columns if c != "i"]), "i")
    found = found.withColumn("may", line_dedup._may_link("x", "y", line_dedup.WHOLE)).select("i", "x", "near", "may").collect()
    assert all(r.may for r in found if r.near) and sum(r.near for r in found) >= 12
    assert not any(r.may for r in found if r.i % 5 == 4 and len(r.x) < 70_000)


def test_blocks_are_cut_where_lengths_differ(spark):
    rows = [(1, 7, 100), (2, 7, 109), (3, 7, 118), (4, 7, 200), (5, 7, 190), (6, 7, 400), (7, 8, 100), (8, 8, 50), (9, 9, 30)]
    frame = spark.createDataFrame([(node, key, sim) for node, key, sim in rows], "node bigint, key bigint, sim int")
    got = line_dedup._shared_lengths(frame, line_dedup.WHOLE).collect()
    assert {(r.node, r.leader, r["head"]) for r in got} == {(1, 1, 100), (2, 1, 100), (3, 1, 100), (4, 4, 200), (5, 4, 200)}
    assert len({r.key for r in got}) == 2


def test_line_links_in_slices_are_all_links(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TEXT_PAIRS", 1)
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 20)
    lines = ["one two three four five six", "seven eight nine ten eleven twelve"]
    docs = spark.createDataFrame(list(enumerate([*lines, *[line + "s" for line in lines]])), TEXT)
    got = {r.doc_id for r in line_dedup.deduplicate(docs, line_dedup.WHOLE).collect() if r.n_removed}
    assert got == {2, 3}
