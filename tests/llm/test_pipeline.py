"""The whole pipeline against a version that compares all pairs, asks SQL for the mix and encodes texts one by one."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from vitalink.llm import mixing, quality
from vitalink.llm.queries import TOKENIZER

from .conftest import prose
from .test_models import brute_contaminated
from .test_simhash_wide import brute_kept, edited


def tables(spark, folder):
    rng = random.Random(11)
    texts = [(k, prose(k, rng.randint(60, 160)), "en", f"s{k % 3}" if k % 11 else None) for k in range(60)]
    texts += [(100 + k, edited(prose(k, 200).split(), k % 3, rng), "en", f"s{k % 3}") for k in range(8)] + [(200 + k, prose(k, 200), "en", "s1") for k in range(8)]
    items = [(k, prose(700 + k, 24)) for k in range(6)]
    texts += [(300 + k, f"{prose(900 + k, 60)} {items[k % 6][1]}", "en", "s2") for k in range(9)]
    texts += [(400, None, "en", "s0"), (401, " ".join(["same"] * 90), "en", "s0"), (402, "too short", "en", "s0")]
    docs = spark.createDataFrame([(*x, None) for x in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(401, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), items


def test_run_matches_brute_force(spark, tmp_path):
    docs, labels, items = tables(spark, str(tmp_path))
    good = {(r.doc_id, r.n_words) for r in quality.judge(docs, labels).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if (r.doc_id, len((r.text or "").split())) in good]
    kept = set(brute_kept([(i, t) for i, t, _ in rows]))
    rows = [x for x in rows if (x[0] is None, x[0] or 0) in kept]
    leaked = {d for d, _ in brute_contaminated([(i, t) for i, t, _ in rows], items)}
    rows = [x for x in rows if x[0] not in leaked]
    documents = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": [x[1] for x in rows], "source": pa.array([x[2] for x in rows], pa.string())})
    known = [x for x in rows if x[0] is not None]
    con = duckdb.connect()
    con.register("documents", documents)
    taken = {r[0]: (r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()}
    tokenizer, want, start = Tokenizer.from_file(TOKENIZER), [], 0
    times = {i: taken[i][1] // taken[i][0] for i, _, _ in rows}
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        for _ in range(times[i]):
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
            want.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(known) < 80 and leaked and len(kept) < len(good)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
