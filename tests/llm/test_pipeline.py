"""The stages of the pipeline on small tables."""

import random

from pyspark.sql import functions as F
from test_llm_sets import brute_components, brute_pairs

import corpus_pipeline
from lexmill.llm import op2_language_id as op2
from lexmill.llm.op8_mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source)."""
    return spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], SCHEMA)


def test_copied_texts_survive_once(spark):
    text = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(i, text, "aa", "s") for i in range(30, 5, -1)] + [(i, f"header\nown words of number {i} are here", "aa", "s") for i in range(40, 52)]
    lines = corpus_pipeline.line_dedup(spark, documents(spark, rows), "")
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == {6: text, **dict.fromkeys(range(7, 31), ""), 40: rows[25][1], **{i: f"own words of number {i} are here" for i in range(41, 52)}}
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, lines, "").where("text like 'one%'").collect()]
    assert kept == [6] and all(r["n_chars"] == len(r["text"]) for r in lines.collect())


def words_of(rng, n, stem):
    return " ".join(f"{stem}{rng.choice('klmnprst')}{rng.choice('aeiou')}{rng.choice('klmnprst')}{rng.choice('aeiou')}" for _ in range(n))


def planted(seed=5):
    """Rows with copies, near copies, common lines, benchmark passages, nulls, empty texts and repeated ids."""
    rng = random.Random(seed)
    bench = [(i, words_of(rng, 30, "q")) for i in range(4)] + [(4, None), (5, "short item of five words")]
    rows = [(i, "\n".join(words_of(rng, 12, "w") for _ in range(4)), "aa", rng.choice(["s", "t", None])) for i in range(60)]
    for i in range(60, 90):  # exact and near copies
        text = rows[rng.randrange(12)][1].split(" ")
        if i % 2:
            text[rng.randrange(len(text))] = "other"
        rows.append((i, " ".join(text), "aa", "u"))
    rows += [(90 + i, f"common header line here\n{words_of(rng, 25, 'v')}", "aa", "s") for i in range(14)]
    rows += [(110, words_of(rng, 20, "z") + " " + bench[1][1].upper() + " " + words_of(rng, 5, "z"), "aa", "s"), (111, bench[2][1], None, "t")]
    rows += [(120, None, "aa", "s"), (121, "", "aa", "s"), (122, "12 34 !?", "aa", "s"), (None, words_of(rng, 30, "y"), "aa", "s"), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows, bench


def brute_stages(rows, bench):
    """What the stages from line dedup on keep, on plain lists: (after lines, after copies, after decontamination)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for n, (d, t, *_) in enumerate(rows):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add((d is None, d if d is not None else n))
    lines = []
    for d, t, lang, source in rows:
        left, seen = [], set()
        for x in (t or "").split("\n"):
            k = key(x)
            if k and len(holders[k]) >= 10 and (k in seen or min(holders[k]) != (d is None, d)):
                continue
            seen.add(k)
            left.append(x)
        lines.append((d, "\n".join(left), lang, source))
    found = brute_components([(d, t) for d, t, *_ in lines], 5, 80)
    by_id = {}
    for d, n, c in found:
        by_id.setdefault(d, []).append((n, c))
    copies, done = [], set()
    for d, t, lang, source in lines:
        if d is not None and by_id[d][0][0] > 0:
            if by_id[d][0][1] != d or d in done:
                continue
            done.add(d)
        copies.append((d, t, lang, source))
    bad = {d for d, _ in brute_pairs([(d, t) for d, t, *_ in copies], bench)}
    return lines, copies, [r for r in copies if r[0] not in bad]


def plain(df):
    return sorted([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()], key=repr)


def test_each_stage_on_its_own_input(spark, tmp_path):
    rows, bench = planted()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows).withColumn("h", F.lit(1)).withColumn("key", F.lit("k"))
    stage = {name: lambda df, f=f: f(spark, df, str(tmp_path)) for name, f in corpus_pipeline.STAGES}
    # The first stage keeps what its models accept; without a letter nothing is.
    kept = plain(stage["language_id"](docs))
    models = op2.fit(docs.select("doc_id", "text", "lang"))
    assert kept == sorted([r for r in rows if not models.predict([r[1] or ""])[3][0]], key=repr)
    assert not {120, 121, 122} & {r[0] for r in kept} and len(kept) >= len(rows) - 5
    lines, copies, clean = brute_stages(rows, bench)
    assert plain(stage["line_dedup"](docs)) == sorted(lines, key=repr)
    assert plain(stage["ngram_jaccard_join"](documents(spark, lines))) == sorted(copies, key=repr)
    assert plain(stage["benchmark_decontamination"](documents(spark, copies))) == sorted(clean, key=repr)
    assert {110, 111} <= {r[0] for r in copies} and not {110, 111} & {r[0] for r in clean}
    mixed = stage["source_mixing"](documents(spark, clean)).collect()
    everything = {(r["doc_id"], r["text"]): r for r in mix_sources(documents(spark, clean), carry=("text",)).collect()}
    assert {(r["doc_id"], r["text"]): (r["size"], r["copies"], r["taken"]) for r in mixed} == {k: (r["size"], r["copies"], r["taken"]) for k, r in everything.items() if r["copies"] > 0}
    for name, f in stage.items():
        out = f(docs.limit(0))
        assert out.count() == 0 and (name == "source_mixing" or set(corpus_pipeline.COLUMNS) == set(out.columns)), name


def test_run_applies_the_stages_in_order(spark, tmp_path):
    rows, bench = planted(6)
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    models = op2.fit(documents(spark, rows))
    accepted = [r for r in rows if not models.predict([r[1] or ""])[3][0]]
    clean = brute_stages(accepted, bench)[2]
    want = {(r["doc_id"], r["text"]): r["copies"] for r in mix_sources(documents(spark, clean), carry=("text",)).collect() if r["copies"] > 0}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]): r["copies"] for r in got} == want and len(got) == len(want)
