"""WARC archives (op9): round trips, the offset index, damage."""

import gzip
import hashlib
import json
import zlib

import pytest

from hammerfield.llm import warc
from hammerfield.llm.files import read_file, write_file
from hammerfield.llm.workspace import new_dir

PAGES = "page_id long, url string, html string, digest string, first string, payload string, n string"


def rows():
    big = "<html>" + "é" * 700
    out = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 9 % 400)) for i in range(120)]
    out += [(200 + i, None, big) for i in range(40)] + [(300, "u", None), (301, "u\r\nWARC-Type: x", ""), (302, "", "x" * 999), (303, "", "x" * 999), (304, "", "y" * 1000), (305, "", "y" * 1000)]
    out += [(306, "http://long", "WARC/1.1\r\n\r\n" * 200_000), (307, "r", "z" * 2000), (307, "r", "z" * 2000)]
    return [r + ("a", "b", "c", "d") for r in out]


def want(pages):
    raw = [(p, (h or "").encode()) for p, _, h, *_ in pages]
    most = {}
    for p, h in raw:
        if len(h) >= 1000:
            most[h] = max(p, most.get(h, p))
    return sorted((p, len(h), hashlib.sha1(h).hexdigest(), *(("revisit", most[h]) if most.get(h, p) != p else ("response", None))) for p, h in raw)


def test_archives_give_the_pages_back(spark):
    pages = rows()
    for rotate in (1 << 12, warc.ROTATE):
        got = warc.archive_pages(spark.createDataFrame(pages, PAGES), rotate=rotate)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want(pages), key=str)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_page_without_an_id(spark):
    frame = spark.createDataFrame([(None, "u", "q" * 2000, *"abcd"), (4, "u", "q" * 2000, *"abcd")], PAGES)
    assert sorted((tuple(r)[:1] + tuple(r)[3:] for r in warc.archive_pages(frame).collect()), key=str) == sorted([(None, "revisit", 4), (4, "response", None)], key=str)


def records(n=30):
    out = []
    for i in range(n):
        payload = bytes([i]) * (i * 37)
        out.append(warc.make_record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None if i % 3 else 77))
    return out


@pytest.mark.parametrize("members", [1, 4, 30])
def test_normaliser_gives_a_member_to_each_record(members):
    made = records()
    joined = b"".join(made)
    step = -(-len(joined) // members)
    data = b"".join(gzip.compress(joined[k : k + step]) for k in range(0, len(joined), step))
    out, index = warc.normalise(data)
    assert [zlib.decompress(out[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == made
    assert gzip.decompress(out) == joined and len(index) == len(made)
    assert warc.normalise(out) == (out, index)  # what is normal stays as it is


def test_damage_is_told():
    whole = gzip.compress(b"".join(records()))
    for broken in (whole[:-20], gzip.compress(b"".join(records()) + b"WARC/1.1\r\nContent-Length: 9\r\n\r\n"), gzip.compress(b"".join(records())[:-3])):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.inflate_records(broken))
    record = warc.make_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None).replace(b"abc\r\n\r\n", b"abd\r\n\r\n")
    with pytest.raises(ValueError):
        warc.read_record(record)


def test_sidecar_index_is_beside_the_archive(spark):
    source, folder = new_dir(spark, "in"), new_dir(spark, "out")
    write_file(f"{source}/a.warc.gz", gzip.compress(b"".join(records())))
    assert warc.normalise_archives(spark, source, folder).first().records == 30
    index = [json.loads(x) for x in read_file(f"{folder}/a.warc.gz.idx").splitlines()]
    data = read_file(f"{folder}/a.warc.gz")
    assert sum(x["length"] for x in index) == len(data) and index[3]["type"] == "revisit"
    assert warc.read_archives(spark, folder).count() == 30
