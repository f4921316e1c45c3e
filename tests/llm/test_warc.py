import hashlib
import random

import pytest
from candela.llm import warc as w


def archive(n=6, packed=True):
    out, at = [], [0]
    for k in range(n):
        one = w.record(k, f"http://x/{k}", (f"page {k} é " * (k * 40 + 1)).encode())
        out.append(w.member(one) if packed else one)
        at.append(at[-1] + len(out[-1]))
    return b"".join(out), at


def ids(found):
    return [int(x["id"][10:-1]) for _, _, x in found if not isinstance(x, str)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    data, at = archive(6, packed)
    assert ids(w.salvage(data)) == [0, 1, 2, 3, 4, 5]
    rng = random.Random(2)
    for _ in range(60):  # one record is damaged or cut out in part, all others come back, and the gap covers the damage
        k = rng.randrange(6)
        spot = rng.randrange(at[k] + 4, at[k + 1] - 6) if packed else at[k + 1] - 5 - rng.randrange(6)  # the plain header has no check sum
        if rng.random() < 0.5:
            bad = data[:spot] + bytes([data[spot] ^ 0x55]) + data[spot + 1 :]
            low, high = at[k], at[k + 1]
        else:
            bad = data[:spot] + data[at[k + 1] :]
            low, high = at[k], spot
        found = list(w.salvage(bad))
        got = ids(found)
        assert set(range(6)) - {k} <= set(got)
        for a, b, x in found:
            if isinstance(x, str):
                assert (a, b) == (low, high)
        if packed:
            assert got == [i for i in range(6) if i != k]


def test_gaps_at_the_ends():
    data, at = archive(2)
    found = list(w.salvage(b"junk" + data + b"\x1f\x8b\x08junk"))
    assert [x if isinstance(x, str) else x["id"] for _, _, x in found][1:3] == ["<urn:page:0>", "<urn:page:1>"]
    assert found[0][:2] == (0, 4) and found[-1][:2] == (4 + len(data), len(data) + 11)
    assert list(w.salvage(b"")) == [] and list(w.salvage(b"WARC/1.1\r\n"))[0][:2] == (0, 10)


def test_two_records_in_a_member():
    data = w.member(w.record(1, None, b"a") + w.record(2, None, b"b"))
    assert ids(w.salvage(data)) == [1, 2]


def test_faults_inside_a_member():
    parts = [w.record(k, f"http://x/{k}", f"page {k} ".encode() * 50) for k in range(5)]
    whole = b"".join(parts)
    after = w.member(w.record(9, None, b"next"))
    bad = whole.replace(b"page 2 page 2", b"page 2 page X", 1)  # a digest that differs: the others come back
    found = list(w.salvage(w.member(bad) + after))
    assert ids(found) == [0, 1, 3, 4, 9] and sum("digest differs" in x for _, _, x in found if isinstance(x, str)) == 1
    junk = b"".join([*parts[:2], b"junk without a record\r\n", *parts[2:]])
    assert ids(w.salvage(w.member(junk) + after)) == [0, 1, 2, 3, 4, 9]
    rough = random.Random(4)
    big = [w.record(k, None, rough.randbytes(9000)) for k in range(40)]
    packed = w.member(b"".join(big))
    torn = list(w.salvage(packed[: len(packed) // 2] + after))  # torn in the middle: what was inflated whole comes back
    assert ids(torn)[-1] == 9 and ids(torn)[:-1] == list(range(len(torn) - 3)) and 15 <= len(ids(torn)) <= 20
    assert torn[-2][2].startswith("member") and torn[-2][1] == len(packed) // 2
    assert ids(w.salvage(packed[: len(packed) // 2]))[0] == 0


def test_short_pages_are_spread(spark):
    """Nine tenths of the pages are short, and no task writes them all."""
    pages = spark.range(4000).selectExpr("id as page_id", "concat('u', id) as url", "case when id % 10 = 0 then repeat(concat('x', id), 400) else concat('s', id) end as html")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = w.read(w.write(pages, archive_bytes=1 << 30)).groupBy("path").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) < 1600


def test_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a/ b\r\nWARC-Type: evil", "x", 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", long, 1), (9, "u", long, 1), (7, "u", long, 1), (9, "u", long, 1), (None, "u", long, 1), (11, "u", "x", 1), (12, "u", "\x00" + "z" * 300_000, 1), (13, "u", "WARC/1.1\r\n\r\n" * 99, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    back = w.read(w.write(pages, archive_bytes=500))
    got = back.where("kind = 'record'").collect()
    assert back.where("kind = 'gap'").count() == 0 and len(got) == len(rows)
    for key, _, body, _ in rows:
        body = (body or "").encode()
        name = None if key is None else f"<urn:page:{key}>"
        mine = [r for r in got if r.id == name]
        assert {(r.bytes, r.digest) for r in mine} == {(len(body), hashlib.sha1(body).hexdigest())}
        revisit = body == long.encode() and key != 9
        assert {(r.type, r.refers_to) for r in mine} == {("revisit", "<urn:page:9>") if revisit else ("response", None)}
        assert revisit or {bytes(r.payload) for r in mine} == {body}
    assert w.read(w.write(pages.limit(0))).count() == 0
