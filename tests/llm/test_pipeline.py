"""The corpus pipeline: every stage and the whole against brute force, with null and repeated ids, empty texts and extra columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline
from docpipe.llm import decontaminate, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, th string, c int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], KIND)


def left(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect()))


def listed(rows):
    return sorted((-1 if i is None else i, t or "") for i, t in rows)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def deduped(rows, n=5, pct=80):
    """Rows of brute-force groups: rows without an id or words stay, of each group the smallest (doc_id, hash of the text)."""
    seen = list(dict.fromkeys(r for r in rows if r[0] is not None))
    sets = []
    for _, t in seen:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(seen)))
    for i in range(len(seen)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [r for r in rows if r[0] is None]
    for g in set(group):
        kept.append(min((seen[k] for k in range(len(seen)) if group[k] == g), key=lambda r: r[0]))
    return kept


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t + " tail") for i, t in enumerate(base[:4])] + [(40, base[0]), (40, base[0])]
    rows += [(None, base[0]), (None, base[0]), (None, None), (50, None), (51, ""), (7, "short one"), (6, "short one"), (5, "another text under this id, not like it")]
    got = left(pipeline.drop_near_duplicates(spark, frame(spark, rows), ""))
    assert got == listed(deduped(rows))
    assert pipeline.drop_near_duplicates(spark, frame(spark, rows).where("false"), "").count() == 0


def test_contaminated(spark, tmp_path):
    rng = random.Random(2)
    items = [prose(rng, 14), prose(rng, 30)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose(rng, 20)), (2, prose(rng, 5) + " " + items[0].upper()), (None, items[1]), (None, prose(rng, 9)), (3, None), (4, ""), (1, items[1][:200]), (2, prose(rng, 8))]
    bad = {rows[1], rows[2], rows[6]}
    assert left(pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))) == listed(r for r in rows if r not in bad)


def test_whole(spark, tmp_path, monkeypatch):
    """run() is its stages one after the other, each tested on its own input, and ends in the library's ids."""
    import public_tokenizers
    import sentencepiece

    rng = random.Random(3)
    bad = ["grunk vlott", "snarp grunk", "vlott snarp"]
    rows = [(i, prose(rng, 30) + (" " + " ".join(rng.choice(bad) for _ in range(3)) if i % 4 == 0 else "")) for i in range(240)]
    items = [prose(rng, 12)]
    rows += [(300, rows[1][1] + " x"), (301, items[0] + " and more"), (None, "no id at all"), (302, None), (302, None), (1, rows[1][1])]
    frame(spark, rows).drop("th", "c").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    mild = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", toxicity.score(docs, model).alias("s")).collect() if r.s < 0.5]
    assert sum(i is not None and i < 240 and i % 4 == 0 for i, _ in mild) <= 3 and all(r in mild for r in rows if r[0] is None or r[0] % 4)
    item = decontaminate.words_of(items[0])
    clean = [(i, t) for i, t in deduped(mild) if not any(decontaminate.words_of(t)[k : k + 10] == item[s : s + 10] for s in range(len(item) - 9) for k in range(len(decontaminate.words_of(t))))]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((-1 if i is None else i, hashlib.sha256(str(sp.encode(t or "")).encode()).hexdigest()) for i, t in clean)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest()) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
