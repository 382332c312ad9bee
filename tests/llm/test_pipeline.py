from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from foliospark.llm.mixing import TARGET_WEIGHTS, mix
from tokenizers import Tokenizer


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    rows = [(k, f"text number {k}", "en", "a" if k >= 300 else "b", 13) for k in range(332)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = [x for x in corpus_pipeline.STAGES if x[0] in ("mixing", "packing")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    monkeypatch.setattr(corpus_pipeline, "BLOCK_ROWS", 16)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = [r["doc_id"] for r in sorted(mix(docs, TARGET_WEIGHTS).collect(), key=lambda r: (r["mix_slot"], r["mix_row"]))]
    n_blocks = -(-(332 + sum(len(r[1]) for r in rows) // 2048) // 16)
    assert {r["doc_id"]: r["sequence_id"] >> 32 for r in got} == {d: k * n_blocks // 332 for k, d in enumerate(order)}
    assert {r["doc_id"] for r in got if r["doc_id"] >= 300} == {d for d in order[:64] if d >= 300}


def test_near_copies_go_row_by_row(spark, tmp_path):
    base = [f"w{k}" for k in range(100)]
    whole, cut = " ".join(base), " ".join(base[:82])
    rows = [(1, whole), (2, cut), (2, "another text of the same id stays here"), (1, whole), (None, whole), (None, "no id but a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.one_of_each_group(spark, spark.read.parquet(f"{tmp_path}/d"), "")
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t in [rows[0], rows[2], rows[5]])


def _stages(spark, docs, folder):
    """The rows after each stage, each one written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_every_stage_over_odd_rows(spark, odd, none, tmp_path):
    words = {"en": "the cat and dog of house with garden", "de": "der hund und die katze im garten"}
    rows = [(1000 + i, f"{words[x]} " * 4 + f"n{i}x{i * 7}y", x, f"s{i % 3}", 5) for i in range(40) for x in words]
    rows += [(2000 + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{y}q" for y in "abcdefgh" * 5), f"l{i:02}", "t", 5) for i in range(70)]
    rows += [(5000, "the cat and dog of house" + " " * 2_000_000 + "with garden", "en", None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.unionByName(more, allowMissingColumns=True)
    stages = _stages(spark, docs, tmp_path / "odd")
    assert all(x.columns == docs.columns for x in stages[:-1])
    known, cut, single, mixed, packed = stages
    before, after = Counter((r["doc_id"], r["text"]) for r in docs.collect()), Counter((r["doc_id"], r["text"]) for r in known.collect())
    assert not after - before and not any(t is None or not any(c.isalpha() for c in t) for _, t in after)
    assert all(k in after for k in before if k[0] is not None and k[0] >= 1000 and k[0] < 2000) and (5000, rows[-1][1]) in after
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert {r["doc_id"] for r in cut.collect()} == {k[0] for k in after} - {7}  # a whole copy of document 6 in long lines
    left, kept = Counter(r["text"] for r in cut.collect()), Counter(r["text"] for r in single.collect())
    assert set(kept) <= set(left) and max(kept.values()) == 1
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == Counter((r["doc_id"], r["text"]) for r in single.collect())
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter((r["doc_id"], tuple(encode(r["text"], add_special_tokens=False).ids) + (0,)) for r in mixed.collect())
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        pieces[r["doc_id"]].append(r)
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, group in pieces.items():
        texts = [t for d, t in want.elements() if d == doc]
        if len(texts) == 1:
            assert tuple(i for r in sorted(group, key=lambda r: r["start"]) for i in r["ids"]) == texts[0]
        else:
            assert sum(r["length"] for r in group) == sum(map(len, texts))
    assert {d for d, _ in want} == set(pieces)
    for group in spans.values():
        group.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(group, group[1:])) and group[0][0] == 0 and sum(n for _, n in group) <= 2048
    assert [x.count() for x in _stages(spark, none, tmp_path / "none")] == [0] * 5


def test_stages_are_removed_but_the_last(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a cat", "en", "a", 5), (2, "a dog", "en", "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 2 and "4-packing" in got.inputFiles()[0]
    folder = got.inputFiles()[0].split("/4-packing")[0]
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    names = [x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    assert names == ["4-packing"]


def test_files_are_ordered_by_number_and_known_by_path(spark, tmp_path):
    names = [f"part-{k:05d}-x.parquet" for k in range(99_994, 100_006)]
    one = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tmp_path / "many"
    folder.mkdir()
    for k, name in enumerate(names):
        frame = spark.createDataFrame([(10 * k + j, f"text {k} {j}", "en", "a", 8) for j in range(3)], one)
        frame.coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(folder / name)
    placed = corpus_pipeline.with_places(spark, spark.read.parquet(str(folder))).collect()
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: r["__place"])] == [10 * k + j for k in range(12) for j in range(3)]
    assert sorted(r["__place"] for r in placed) == list(range(36))


def test_equal_names_in_two_folders(spark, tmp_path):
    one = "doc_id long, text string, lang string, source string, n_chars long"
    same, other, third = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    for sub, rows in (("p0", [(1, same), (2, other)]), ("p1", [(3, third), (4, same)])):
        spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], one).coalesce(1).write.parquet(f"{tmp_path}/w{sub}")
        (tmp_path / "in" / sub).mkdir(parents=True)
        next((tmp_path / f"w{sub}").glob("*.parquet")).rename(tmp_path / "in" / sub / "part.parquet")
    docs = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 2, 3]
