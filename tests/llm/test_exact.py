"""Operators whose results SQL or a few lines of Python define exactly: 3, 7, 8, 10."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vitalink.llm import mixing, substring, tokens, warc
from vitalink.llm.common import shared_dir, window_hashes

from .conftest import awkward, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------ substring dedup


def brute_repeats(texts, window=20):
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, texts[k][1] or ""))
    seen, out = set(), []
    for k in order:
        w = words(texts[k][1])
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out.append((str(texts[k][0]), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [2_000, 8 << 20])
def test_repeats_match_brute_force(odd, chunk_bytes):
    passage = " ".join(words(prose(77, 60)))
    texts = awkward()
    got = substring.repeats(odd, chunk_bytes=chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(texts)
    assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in got)
    assert passage


def test_repeats_of_a_shared_passage(table, none):
    passage = " ".join(words(prose(77, 25)))
    texts = [(k, f"{prose(k, 40 + k)}\t{passage}\n{prose(1000 + k, 7 * k)}", "en", "a") for k in range(30)]
    got = substring.repeats(table(texts)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(texts)
    assert substring.repeats(none).count() == 0


def test_window_hashes_depend_on_the_window_alone():
    h = np.random.default_rng(0).integers(0, 1 << 63, 100, dtype=np.uint64)
    for n in (1, 2, 3, 7, 10, 20):
        a = window_hashes(h, n)
        assert len(a) == 101 - n
        assert a[5] == window_hashes(h[5 : 5 + n].copy(), n)[0]
        assert len(set(a.tolist())) == len(a)


# ------------------------------------------------------------------ token records


def test_token_records_round_trip(spark, odd, none):
    tokenizer = Tokenizer.from_file(PATH)
    texts = sorted(awkward(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for i, t, _, _ in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = shared_dir(spark)
    manifest = tokens.write_records(odd, out, PATH, shard_bytes=20_000)
    got = tokens.read_records(manifest).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    last = manifest.orderBy("part").collect()[-1]
    key, ids = tokens.read_record(last["uri"], 0)
    assert last["n_docs"] >= 1 and ids[-1] == 0 and key is not None
    assert sorted(r.start for r in tokens.starts(manifest, block=2).collect()) == sorted(r.start for r in tokens.starts(manifest).collect())
    assert tokens.token_records(none, PATH).count() == 0


def test_damaged_records_are_noticed():
    data = tokens.frame(7, np.array([1, 2, 0], "<u2").tobytes())
    assert tokens.parse(data, 2)[0] == 7
    for k in (0, 9, 14, len(data) - 1):
        with pytest.raises(ValueError):
            tokens.parse(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :], 2)


def test_piece_encoder_equals_whole_encoding():
    encoder = tokens.PieceEncoder(PATH, most=50)
    odd = ["", " ", "  a b", "a  b", "a \n b", "x\n y", " lead", "trail ", "\tq r", "a <|endoftext|> b", "a  b c", "it's 'tis don't a 'll b", "é ñ  x", "a b\n", "\n a", "a\x1c b c", "x 12 3,4 !?", "a 　b", "x  y z"]
    odd += [t or "" for _, t, _, _ in awkward()]
    for at in range(0, len(odd), 7):
        assert encoder.encode(odd[at : at + 7]) == encoder._whole(odd[at : at + 7])


def test_pieces_are_cut_where_the_tokenizer_splits():
    encoder = tokens.PieceEncoder(PATH, most=200)
    signs = "aZéßÀž×÷ªµйя中ไ \u0301'’“.,%5²٣ \n\t\r\x0b\x1c\x85\u00a0\u1680\u2003\u2028\u3000😀\ufeff\x00"
    draw = random.Random(5)
    odd = ["".join(draw.choices(signs, weights=[9] * 6 + [2] * 16 + [12, 4] + [1] * (len(signs) - 24), k=draw.randrange(60))) for _ in range(3000)]
    odd += ["a.<|endoftext|>b c", "it's l'été 'll 'Re x'llama"]
    for at in range(0, len(odd), 101):
        assert encoder.encode(odd[at : at + 101]) == encoder._whole(odd[at : at + 101])


def test_words_are_encoded_once_whatever_follows_them():
    encoder = tokens.PieceEncoder(PATH)
    stems = [f"{a}lim{b}" for a in "abcdefghij" for b in "abcde"]
    text = " ".join(f"{x}{y}" for x in stems for y in (".", ",", "%%%", ";", ".\nThe", "\nOf", "!", "?"))
    assert encoder.encode([text]) == encoder._whole([text])
    assert len(encoder.words) <= len(stems) + 20  # 399 before


def test_kept_pieces_take_little_memory():
    encoder, rng = tokens.PieceEncoder(PATH), random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(10_000)) for _ in range(8)]
    tracemalloc.start()
    got = [encoder.encode([x])[0] for x in texts]
    python = tracemalloc.get_traced_memory()[0] - sum(map(len, got))
    tracemalloc.stop()
    assert len(encoder.words) > 79_000
    assert python + pa.total_allocated_bytes() < 6_000_000


def test_pieces_used_last_are_kept():
    encoder = tokens.PieceEncoder(PATH, most=20)
    for k in range(9):
        text = " ".join(["stay", *(f"{chr(97 + k)}{chr(97 + x)}" for x in range(12))])
        assert encoder.encode([text]) == encoder._whole([text])
        assert len(encoder.words) <= 20 + 13 and b" stay" not in encoder.words.to_pylist() and b"stay" in encoder.words.to_pylist()


# ------------------------------------------------------------------ archives


def test_archives_round_trip(spark):
    long, other = "<html>" + "x" * 200 + "</html>", "<html>é" + "y" * 300
    pages = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, long), (4, "http://b c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", long)]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, id int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table).collect())
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        same = [j for j, _, h in pages if h == html and j is not None] if len(body) >= 100 else []
        refers = min(same) if same and min(same) != i else None
        want.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want)
    assert warc.round_trip(table.where("false")).count() == 0


def test_archive_layout(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html><body><p>{prose(k, 200)}</p></body></html>") for k in range(400)], "page_id long, url string, html string").coalesce(1)
    out = shared_dir(spark)
    ((uri, n),) = warc.write_archives(pages, out).collect()
    assert n == 400
    data = open(uri.removeprefix("file://") + ".warc.zst", "rb").read()
    assert data[:4] == bytes.fromhex("5D2A4D18") and int.from_bytes(data[4:8], "little") > 0
    records = list(warc.read_archive(uri))
    assert len(records) == 400 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    plain = warc.parse(records[0])
    assert plain[6].startswith(b"<html>") and plain[4] == "response"


def test_every_archive_has_a_dictionary_of_the_whole(spark):
    """Whatever the number and size of the records; samples come from all of the archive."""
    for records in ([b"x"], [b""], [b"WARC " * 9], [bytes([k]) * 50 for k in range(5)], [prose(1, 3000).encode()], [prose(k, 30).encode() for k in range(300)]):
        assert 0 < len(warc.build_dictionary(records, 4096)) <= 4096 or not any(records)
    late = [bytes([65 + k % 20]) * 30 for k in range(4000)] + [b"<nav>only at the end of it</nav>" + prose(k, 20).encode() for k in range(4000)]
    assert b"only at the end" in warc.build_dictionary(late, 4096)
    pages = spark.createDataFrame([(k, None, prose(k, 60)) for k in range(200)] + [(900, None, "z" * 300_000)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, shared_dir(spark), archive_bytes=20_000)
    assert manifest.count() > 3 and warc.read_archives(manifest).count() == 201
    for r in manifest.collect():
        data = open(r.uri.removeprefix("file://") + ".warc.zst", "rb").read()
        assert int.from_bytes(data[4:8], "little") > 0


def test_references_beyond_the_broadcast(spark):
    pages = spark.createDataFrame([(k, None, prose(k % 7 if k % 3 else k, 60)) for k in range(300)], "page_id long, url string, html string")
    rows = lambda **options: sorted(map(tuple, warc.round_trip(pages, **options).collect()), key=str)
    assert rows() == rows(few=0) and any(r[3] == "revisit" for r in rows())


# ------------------------------------------------------------------ mixing


def test_water_filling():
    sizes, weights = {"a": 100, "b": 1000, None: 10}, {"a": 5, "b": 2, None: 1}
    got = mixing.water_fill(sizes, weights, 1.5, 2)
    assert got["a"] == 200 and got[None] == 20 and abs(sum(got.values()) - 1.5 * 1110) < 1e-6


def test_flow_prefers_first_copies():
    got = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 9}, 2)
    assert sum(v.get("a", 0) for v in got.values()) == 12 and sum(v.get("b", 0) for v in got.values()) == 9
    again = sum(max(0, sum(v.values()) - size) for v, size in zip(got.values(), (10, 10, 2), strict=True))
    assert again == 0


def test_mix_meets_targets(odd, none):
    rows = mixing.mix(odd).collect()
    texts = awkward()
    assert len(rows) == len(texts)
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t, _, _ in texts)
    by = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), part in by.items():
        assert abs(sum(r.taken for r in part) - target) <= max(r.size for r in part)
    again = mixing.mix(odd).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = spark.createDataFrame([(k, "w " * 10, [["a"], ["b"], ["a", "b"], None][k % 4]) for k in range(80)], "doc_id long, text string, source array<string>")
    got = mixing.mix(rows).collect()
    assert len(got) == 80 and {r.size for r in got} == {10} and sum(r.taken for r in got) > 0
