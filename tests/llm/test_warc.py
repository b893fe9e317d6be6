import base64
import gzip
import hashlib
import random
from pathlib import Path

import zstandard

from lodestone.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    count = {}
    for _, _, html in rows:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        to = first.get(p) if count[html or ""] > 1 and len(p) >= least else None
        to = to if to is not None and to != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.where("status = 'record'").collect()), key=str)


def pages():
    rng = random.Random(3)
    html = [f"<p>{rng.random()}</p>\r\n\r\nWARC/1.1 inside é\x00" * rng.randint(1, 30) for _ in range(40)]
    rows = [(i, f"http://h.example/{i} x", h) for i, h in enumerate(html)]
    rows += [(50 + i, None, html[3]) for i in range(30)] + [(90, "", None), (91, "u", ""), (92, "é\n", None), (93, "big", "z" * 3_000_000)]
    return rows + [(None, "n", "only null id"), rows[5], rows[5]]


def test_round_trip(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), records_per_file=25)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert got.where("status = 'gap'").count() == 0 and result(got) == brute(rows)
    texts = {(r["page_id"], bytes(r["payload"])) for r in got.where("record_type = 'response'").collect()}
    assert texts == {(i, (h or "").encode()) for (i, _, h), b in zip(sorted(rows, key=str), range(len(rows))) if (i, "response") in {(x[0], x[3]) for x in brute(rows)}}


def test_least_revisit_size_empty_and_clashing(spark, tmp_path):
    rows = [(1, "a", "same page"), (2, "b", "same page"), (3, "c", "x"), (4, "d", "x")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'own' as digest", "1 as _d", "2 as payload", "3 as first_id", "4 as _n")
    warc.write_archives(df, str(tmp_path / "w"), least=5)
    assert result(warc.read_archives(spark, str(tmp_path / "w"))) == brute(rows, 5)
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def record(i, body=b"<html>"):
    return warc.encode_record(i, f"http://x/{i}", body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)


def tiles(data):
    found = list(warc.salvage(data))
    return [x[3].head["x-page-id"] for x in found if x[0] == "record"], [(x[1], x[2]) for x in found if x[0] == "gap"]


def test_salvage_zstd_gzip_and_plain():
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    for wrap in (lambda r: pack(r) + warc.TAIL + b"\n", gzip.compress, lambda r: r):
        members = [wrap(record(i, b"payload %d " % i * 50)) for i in range(6)]
        assert tiles(b"".join(members)) == ([str(i) for i in range(6)], [])
        start = len(b"".join(members[:2]))
        hurt = bytearray(b"".join(members))
        hurt[start + len(members[2]) // 2] ^= 0xFF
        ids, gaps = tiles(bytes(hurt))
        assert ids == ["0", "1", "3", "4", "5"] and len(gaps) == 1 and gaps[0][0] == start
        cut = b"".join(members[:3])[:-40]
        ids, gaps = tiles(cut)
        assert ids == ["0", "1"] and len(gaps) == 1 and gaps[0][0] == start and gaps[0][1] == len(cut)
        ids, gaps = tiles(b"garbage before " + b"".join(members) + b"garbage after")
        assert ids == [str(i) for i in range(6)] and len(gaps) == 2 and gaps[0] == (0, 15)


def test_salvage_only_garbage_and_nothing():
    assert tiles(b"") == ([], [])
    noise = bytes(random.Random(1).randrange(256) for _ in range(5000))
    ids, gaps = tiles(noise)
    assert not ids and gaps and gaps[-1][1] == len(noise)


def test_false_magic_inside_a_gap_is_passed_over():
    data = record(1) + b"WARC/1.0 no record \x28\xb5\x2f\xfd \x1f\x8b\x08" + record(2)
    ids, gaps = tiles(data)
    assert ids == ["1", "2"] and gaps == [(len(record(1)), len(data) - len(record(2)))]


def test_damaged_file_through_spark(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 200) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    for f in Path(tmp_path / "w").glob("part-*"):
        data = bytearray(f.read_bytes())
        data[len(data) // 2] ^= 0x55
        f.write_bytes(bytes(data))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    got = warc.read_archives(spark, str(tmp_path / "w")).cache()
    gaps = got.where("status = 'gap'").collect()
    assert gaps and all(g["reason"] and g["stop"] > g["start"] for g in gaps)
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("status = 'record'").collect()}
    assert len(back) >= 55 and all(back[i] == rows[i][2] for i in back)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in warc.op3_query(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_members_of_many_records_keep_what_is_whole():
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    rng = random.Random(4)
    for wrap in (pack, gzip.compress):
        records = [record(i, rng.randbytes(3000)) for i in range(60)]
        hurt = [bytearray(r) for r in records]
        hurt[20][-100] ^= 0xFF  # a digest
        hurt[40][2] ^= 0xFF  # a version line
        data = wrap(b"".join(map(bytes, hurt)))
        ids, gaps = tiles(data)
        assert ids == [str(i) for i in range(60) if i not in (20, 40)] and gaps == [(0, len(data))] * 2
        reasons = [x[3] for x in warc.salvage(data) if x[0] == "gap"]
        assert f"inner offset {20 * len(records[0]) + sum(len(r) - len(records[0]) for r in records[:20])} " in reasons[0]
        whole = wrap(b"".join(records))
        ids, gaps = tiles(whole[:-8000] + wrap(record(99)))
        assert ids[:20] == [str(i) for i in range(20)] and ids[-1] == "99" and len(gaps) == 1
        ids, gaps = tiles(whole[:-2])  # only the checksum is cut
        assert ids == [str(i) for i in range(60)] and len(gaps) == 1


def test_damaged_members_give_no_record_twice_or_unproved():
    records = [record(i, b"body %d " % i * 200) for i in range(6)]
    stored = bytearray(gzip.compress(b"".join(records), 0))
    stored[-6] ^= 0xFF  # the member's checksum
    assert tiles(bytes(stored) + gzip.compress(record(9)))[0] == [*map(str, range(6)), "9"]
    bare = b"WARC/1.1\r\nWARC-Type: resource\r\nX-Page-Id: 7\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    data = bytearray(gzip.compress(bare + records[0]))
    data[-6] ^= 0xFF
    assert tiles(bytes(data))[0] == ["0"]


def test_a_damaged_record_in_the_middle_costs_one_record():
    records = [record(i, b"body %d " % i * 200) for i in range(6)]
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + len(records[1]) + len(records[2]) // 2] ^= 0xFF
    ids, gaps = tiles(gzip.compress(bytes(plain)))
    assert ids == ["0", "1", "3", "4", "5"] and len(gaps) == 1
