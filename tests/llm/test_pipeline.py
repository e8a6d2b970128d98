"""The pipeline on planted rows, and the registered queries."""

import random

import brute

import corpus_pipeline
from weftline.llm import decontaminate, pii, toxicity
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["lo", "mi", "ka", "ter"]) + r.choice(["na", "so", "re", "ti", "va"]) + str(r.randrange(9)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(12))
    texts = [say(40) for _ in range(120)]
    for i in range(0, 40):
        texts[i] += " blorf " + say(3) + " blorf"
    texts[50] = texts[60] + " end"
    texts[70] += " " + item + " " + say(30)
    texts[80] += " mail me@here.org now"
    texts[90], texts[91] = None, ""
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen.append({x.doc_id: x for x in after.collect()})
        assert after.columns == d.columns or name == "best_fit_packing"
        d = after
    assert set(seen[0]) == set(range(40, 120))
    assert set(seen[1]) == set(seen[0]) - {60} and brute.components([(i, texts[i]) for i in seen[0]])[60][1] == 50
    assert set(seen[2]) == set(seen[1]) and "bench" not in seen[2][70].text and seen[2][70].n_chars == len(seen[2][70].text)
    assert seen[3][80].text.endswith("mail [EMAIL] now") and set(seen[3]) == set(seen[2])
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs([])
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        assert d.count() == 0


def test_cases_of_each_stage(spark, docs, clashing, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names, stage by stage."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["lo", "mi", "ka", "ter"]) + r.choice(["na", "so", "re", "ti", "va"]) + str(r.randrange(99)) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(11))
    bad = [say(20) + " blorf " + say(3) for _ in range(30)]
    good = [say(40) for _ in range(30)]
    # 16 shingles of which two texts share 15 of 17 are a link; at exactly 0.8 too: 8 of 10.
    tie = say(13)
    odd = [None, None, "", " \n", "solo", "solo", tie, tie.rsplit(" ", 1)[0] + " other", item, item + " and me@here.org", "x " * 5000 + item, "mail +1 (312) 555-0199 now"]
    texts = bad + good + odd + [good[3]] * 4
    ids = [*range(len(bad) + len(good) + len(odd)), *[33] * 4]
    labels = [(i, 1, int(i < 30)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = clashing(docs(texts, ids=ids)).unionByName(clashing(docs(["no id", None], ids=[None, None])))
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    rows = lambda d: sorted((x.doc_id is None, x.doc_id or 0, x.text is None, x.text or "") for x in d.collect())

    kept = stages["toxicity"](spark, whole, at)
    assert kept.columns == whole.columns and kept.dtypes == whole.dtypes
    assert rows(kept) == [x for x in rows(whole) if " blorf " not in x[3]]

    one = stages["ngram_jaccard_join"](spark, kept, at)
    component = brute.components([(i, t) for i, t in zip(ids[30:72], texts[30:72], strict=True)])
    assert one.columns == whole.columns and sorted({x.doc_id for x in one.where("doc_id is not null").collect()}) == sorted(i for i, (_, c) in component.items() if c == i)
    assert one.where("doc_id = 33").count() == 5  # rows of one document
    assert one.where("doc_id is null").count() == 2

    clean = stages["benchmark_decontamination"](spark, kept, at)
    told = {x.doc_id: x for x in clean.collect()}
    assert clean.columns == whole.columns and clean.count() == kept.count() - 1 and 68 not in told  # the item alone
    assert told[69].text.strip() == "and me@here.org" and told[70].text == "x " * 5000 and told[60].text is None and told[62].text == ""
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in told.values())

    safe = {x.doc_id: x for x in stages["pii"](spark, kept, at).collect()}
    assert safe[69].text == item + " and [EMAIL]" and safe[71].text == "mail [PHONE] now" and safe[60].text is None and safe[62].text == ""
    assert stages["pii"](spark, kept, at).count() == kept.count()

    packed = stages["best_fit_packing"](spark, kept, at).collect()
    assert len({(x.sequence_id, x.offset) for x in packed}) == len(packed) and sum(x.piece == 0 for x in packed) == kept.count()
    assert all(x.length == 1 for x in packed if x.doc_id in (60, 61, 62))


def test_queries(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        key = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want), name


def test_clean_documents_stay(spark):
    """On the small table every stage keeps what it has no reason to change."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.report(d, item).where("contaminated").collect()}
    kept = {r.doc_id: r.text for r in decontaminate.remove_spans(d, item).collect()}
    assert all(kept[r.doc_id] == r.text for r in d.collect() if r.doc_id not in hit)
    found = {r.doc_id for r in pii.report(d).where("spans <> ''").collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert all(redacted[r.doc_id] == r.text for r in d.collect() if r.doc_id not in found)
    assert toxicity.keep_clean(d, None).count() == d.count()


def test_toxicity_stage_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    score = lambda t: model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(toxicity.words_of(t)))
    want = {r.doc_id for r in d.collect() if score(r.text) < 0}
    assert {r.doc_id for r in toxicity.keep_clean(d, model).collect()} == want and len(want) > 0.8 * d.count()
