import random

import corpus_pipeline

from wayfold.llm import sharding


def test_stages_work_on_what_their_predecessor_kept(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        body = text(rng.randrange(20, 90))
        if i % 5 == 0:
            body += " worthless idiot, pathetic moron"
        if i % 7 == 3:
            body = rows[rng.randrange(len(rows))][1] + " tail"
        if i % 11 == 4:
            body += " " + items[i % 5][1]
        rows.append((i, body, "en", f"s{i % 4}", len(body)))
        labels.append((i, 1, int("idiot" in body)))
    rows += [(900, None, None, None, 0), (901, "", "en", "s1", 0), (902, "same words again here now", "en", "s1", 0), (902, "same words again here now", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]

    got, cur = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, cur, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        cur = spark.read.parquet(f"{tmp_path}/{name}")
        assert cur.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
        got[name] = cur.collect()
    bodies = {r[0]: r[1] or "" for r in rows}
    ids = {name: {r.doc_id for r in out} for name, out in got.items()}
    assert ids["toxicity"] == {d for d in bodies if "idiot" not in bodies[d]}

    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := bodies[d].split()) else set() for d in ids["toxicity"]}
    like = {d: {e for e in sets if sets[d] and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])} for d in sets}
    left = set()
    for d in sorted(sets):
        if not sets[d] or not reach(d, like) & left:
            left.add(d)
    assert ids["minhash_near_dedup"] == left
    assert ids["benchmark_decontamination"] == {d for d in left if not any(t in bodies[d] for _, t in items)}
    mixed = got["source_mixing"]
    assert ids["source_mixing"] <= ids["benchmark_decontamination"] and len(mixed) > len(ids["benchmark_decontamination"])
    assert sorted((r.doc_id, r.text or "") for r in mixed) == sorted((r.doc_id, r.text or "") for r in got["sharding"])
    for s in range(sharding.SHARDS):
        slots = sorted(r.slot for r in got["sharding"] if r.shard == s)
        assert slots == list(range(len(slots)))


def reach(d, like):
    seen, todo = {d}, [d]
    while todo:
        for e in like[todo.pop()] - seen:
            seen.add(e)
            todo.append(e)
    return seen


def test_the_pipeline_of_no_documents_is_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words of an item that is long enough to be looked for")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
