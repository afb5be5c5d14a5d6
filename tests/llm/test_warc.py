from __future__ import annotations

import gzip
import random
import re

import pytest

from tallyweave.llm.batches import folder
from tallyweave.llm.warc import END, archived, parse, read, record, salvage, sha1, write

RECORDS = [record(i, f"http://x/{i}", (f"<p>WARC/1.1\r\n{i}</p>" * i).encode(), None, False) + b"\r\n\r\n" for i in range(1, 9)]


def ids(data):
    named = [re.fullmatch("<urn:page:([0-9]+)>", r["warc-record-id"]) for _, _, r, _ in salvage(data) if r]
    return [int(m[1]) if m else None for m in named]


def test_whole_archives():
    assert ids(b"".join(RECORDS)) == list(range(1, 9))
    assert ids(b"".join(gzip.compress(r) for r in RECORDS)) == list(range(1, 9))
    assert ids(gzip.compress(b"".join(RECORDS)) + RECORDS[0]) == [*range(1, 9), 1]
    assert list(salvage(b"")) == []


@pytest.mark.parametrize("zipped", [False, True])
def test_damage(zipped):
    pick = random.Random(4)
    parts = [gzip.compress(r) if zipped else r for r in RECORDS]
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    for _ in range(150):
        data = bytearray(whole)
        hit = pick.randrange(8)
        place = pick.randrange(starts[hit] + (10 if zipped else 0), starts[hit + 1] - (0 if zipped else 4))
        data[place] ^= 1 << pick.randrange(8)
        found = list(salvage(bytes(data)))
        assert {*range(1, 9)} - {hit + 1} <= set(ids(bytes(data)))
        assert sum(n for _, n, r, _ in found if r is None) + sum({a: n for a, n, r, _ in found if r}.values()) == len(data)  # no byte is lost
    for cut in (3, 40, len(parts[3]) - 2):
        data = b"".join(parts[:3]) + parts[3][:cut] + b"".join(parts[4:])
        assert ids(data) == [1, 2, 3, 5, 6, 7, 8]
        assert [(a, n) for a, n, r, _ in salvage(data) if r is None] == [(starts[3], cut)]
    assert [(a, n) for a, n, r, _ in salvage(b"junk" + whole[: starts[2]] + b"tail") if r is None] == [(0, 4), (starts[2] + 4, 4)]


def test_damage_in_a_member_of_several_records():
    """One bad record costs itself; a member that breaks keeps the records before the break, and what follows it."""
    whole = b"".join(RECORDS)
    bad = RECORDS[3].replace(b"</p>", b"</q>", 1)
    data = gzip.compress(whole.replace(RECORDS[3], bad)) + gzip.compress(RECORDS[0])
    assert ids(data) == [1, 2, 3, 5, 6, 7, 8, 1]
    assert [(a, n, "digest" in why) for a, n, r, why in salvage(data) if r is None] == [(0, 0, True)]
    pick = random.Random(5)
    large = [record(i, "u", pick.randbytes(5000).hex().encode(), None, False) + b"\r\n\r\n" for i in range(1, 9)]
    member = gzip.compress(b"".join(large))
    for broken in (member[: len(member) // 2], member[: len(member) // 2] + b"\xff" * 400 + member[len(member) // 2 + 400 :]):
        data = broken + gzip.compress(RECORDS[0])
        got = ids(data)
        assert got[:3] == [1, 2, 3] and got[-1] == 1 and len(got) == len(set(got[:-1])) + 1
        assert [(a, n) for a, n, r, _ in salvage(data) if r is None and n] == [(0, len(broken))]
        assert sum(n for _, n, _, _ in salvage(data)) == len(data)


def test_reasons():
    for data, said in ((b"x", "version"), (b"WARC/1.1\r\n", "end"), (b"WARC/1.1\r\nA: b\r\n\r\n", "length"), (RECORDS[0].replace(b"<p>", b"<q>"), "digest")):
        with pytest.raises(ValueError, match=said):
            parse(data, 0)


def test_round_trip(spark):
    rows = [
        (5, "http://a/ b\n", "same"), (3, "http://é", "same"), (9, None, "same"), (4, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (None, "u", "same"),
        (8, "u", "long " * 300_000), (3, "http://é", "same"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, sha string")
    path = folder(spark, "warc")
    got = sorted(map(tuple, archived(df, path).collect()), key=str)
    first = {"same": 3, "": 4}
    want = []
    for i, _, h in rows:
        data, to = (h or "").encode(), first.get(h or "")
        again = to is not None and to != i
        want.append((i, len(data), sha1(data), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=str)
    payloads = {r.record_id: bytes(r.payload) for r in read(spark, path).collect() if r.record_type == "response"}
    assert payloads["<urn:page:8>"] == b"long " * 300_000 and payloads["<urn:page:4>"] == b""


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert archived(df, folder(spark, "warc")).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """A file ends before it gets too long, whatever the sizes; a longer record has its own, and all are read back."""
    sizes = [10, 4000, 10, 10, 90_000, 10, 3000, 3000, 3000, 0]
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    write(df, "page_id", "url", "html", str(tmp_path / "w"), per_file=4, file_bytes=8000)
    files = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(files) > 3 and sorted(files)[-2] <= 8000 + len(END) and max(files) > 90_000
    found = read(spark, str(tmp_path / "w")).collect()
    assert sorted(len(r.payload) for r in found) == sorted(sizes) and all(r.gap is None for r in found)
