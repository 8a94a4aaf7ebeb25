import gzip
import hashlib
import random

from callmeter.llm import warc

SCHEMA = "page_id long, url string, html string, offset string"
LEAVES = "warc_file string, offset long, length long, sha256 string"


def archive(rng, n):
    return [f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
            for b in (bytes(rng.randrange(256) for _ in range(rng.choice([10, 300, 3000]))) for _ in range(n))]


def rows(r):
    return sorted((x.warc_file, x.offset, x.fault) for x in r.collect())


def test_files_read_back_and_damage_located(spark, tmp_path):
    rng = random.Random(1)
    for side in "ab":
        (tmp_path / side).mkdir()
    want = []
    for f in range(4):
        records = archive(rng, 60)
        (tmp_path / f"a/{f}.warc.gz").write_bytes(gzip.compress(b"".join(records)))
        at = 0
        for i, r in enumerate(records):
            if f != 2 and i % 25 == 7:
                records[i] = r[:-5] + bytes([r[-5] ^ 1]) + r[-4:]
                want.append((f"{f}.warc", at, "changed"))
            at += len(r)
        if f == 3:
            cut = len(records[-1])
            records.pop()
            want.append((f"{f}.warc", at - cut, "missing"))
        (tmp_path / f"b/{f}.warc").write_bytes(b"".join(records))
    a, b = (warc.read_leaves(spark, str(tmp_path / s)) for s in "ab")
    assert a.count() == 240
    assert rows(warc.audit(a, b)) == sorted(want)
    assert rows(warc.audit(a, a)) == []


def test_audit_against_a_full_comparison(spark):
    rng = random.Random(3)
    sides = [{}, {}]
    for f in ("x", "y", None):
        at = 0
        for _ in range(300):
            n = rng.choice([200, 5000, 70_000, 20_000_000])
            for s in sides:
                if rng.random() > 0.02:
                    s[f, at] = (n, "same" if rng.random() > 0.02 else str(rng.random()))
            at += n
    frames = [spark.createDataFrame([(f, o, n, h) for (f, o), (n, h) in s.items()], LEAVES) for s in sides]
    got = {(r.warc_file, r.offset): (r.fault, r.expected_sha256, r.found_sha256) for r in warc.audit(*frames).collect()}
    a, b = sides
    want = {k: ("missing" if k not in b else "extra" if k not in a else "changed", a.get(k, (0, None))[1], b.get(k, (0, None))[1])
            for k in a.keys() | b.keys() if a.get(k, (0, None))[1] != b.get(k, (0, None))[1]}
    assert got == want
    assert warc.audit(frames[0].limit(0), frames[0].limit(0)).count() == 0
    assert warc.audit(frames[0], frames[0].limit(0)).count() == len(a)


def test_a_repeated_record_is_a_difference(spark):
    one = spark.createDataFrame([("f", 0, 5, "h"), ("f", 5, 5, "i")], LEAVES)
    assert rows(warc.audit(one, one.union(one.limit(1)))) == [("f", 0, "changed")]


def test_page_records_nulls_and_repeats(spark):
    df = spark.createDataFrame([(2, "u", "é", "x"), (None, None, None, "x"), (2, "u", "é", "x"), (3, "v", "", "x")], SCHEMA)
    got = warc.page_leaves(df, per_file=2).orderBy("warc_file", "offset").collect()
    record = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:2>\r\nWARC-Target-URI: u\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    assert [(r.warc_file, r.page_id) for r in got] == [(0, None), (0, 2), (1, 2), (1, 3)]
    assert got[1].sha256 == hashlib.sha256(record).hexdigest() and got[1].length == len(record)
    assert got[0].offset == 0 and got[1].offset == got[0].length and got[3].offset == len(record)
    assert [len(r) for _, r in warc.records(record * 3 + b"junk")] == [len(record)] * 3 + [4]
    assert warc.page_leaves(df.limit(0)).count() == 0


def test_any_change_among_records_at_one_offset_is_seen(spark):
    def leaves(hashes):
        return spark.createDataFrame([("f", 7, 5, h) for h in hashes], LEAVES)
    sides = ["ace", "ade", "aace", "acce", "ac", "eca"]
    for x in sides:
        for y in sides:
            assert bool(rows(warc.audit(leaves(x), leaves(y)))) == (sorted(x) != sorted(y)), (x, y)


def test_files_of_one_name_in_several_folders_are_archives_of_their_own(spark, tmp_path):
    rng = random.Random(2)
    one, two = b"".join(archive(rng, 5)), b"".join(archive(rng, 5))
    for side, contents in (("a", (one, two, one)), ("b", (two, one, one))):
        for k, content in enumerate(contents):
            (tmp_path / side / f"d{k}").mkdir(parents=True)
            (tmp_path / side / f"d{k}" / "x.warc").write_bytes(content)
    a, b = (warc.read_leaves(spark, str(tmp_path / s)) for s in "ab")
    assert {r.warc_file for r in a.select("warc_file").distinct().collect()} == {"d0/x.warc", "d1/x.warc", "d2/x.warc"}
    assert {f for f, _, _ in rows(warc.audit(a, b))} == {"d0/x.warc", "d1/x.warc"}
    single = warc.read_leaves(spark, str(tmp_path / "a" / "d0" / "x.warc"))
    assert {r.warc_file for r in single.collect()} == {"x.warc"}
