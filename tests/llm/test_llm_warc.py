import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from spendlens.llm import warc
from spendlens.llm.queries import op1_warc

LONG = "<html>" + "abc " * 40 + "</html>"
PAGES = [
    (5, "http://a/5", LONG),
    (3, "http://a/3", LONG),
    (9, None, LONG),
    (3, "http://a/3", LONG),
    (9, "http://a/9", LONG),
    (1, "http://a/1", "short"),
    (2, "http://a/\r\n2", "short"),
    (4, "http://a/4", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "é\r\n\r\nWARC/1.1\r\n" * 50),
    (8, "http://a/8", "x" * 300_000),
    (-1, "http://a/-1", "y" * 99),
    (-2, "http://a/-2", "y" * 99),
    (-3, "http://a/-3", "z" * 100),
    (-4, "http://a/-4", "z" * 100),
]


def brute(pages):
    firsts = {}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            firsts[payload] = min(firsts.get(payload, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        first = firsts.get(payload)
        again = first is not None and page_id is not None and page_id > first
        digest = hashlib.sha256(payload).hexdigest()
        out.append((page_id, len(payload), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture
def run(spark, tmp_path):
    def go(pages, extra=False):
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        if extra:
            df = df.withColumn("payload", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("refers_to", F.lit(2))
        df.write.parquet(str(tmp_path / "pages.parquet"))
        got = op1_warc(spark, str(tmp_path)).collect()
        return sorted([tuple(r)[:5] for r in got], key=str)

    return go


def test_round_trip(run):
    assert run(PAGES) == brute(PAGES)


def test_clashing_columns_and_unknown_ids(run):
    pages = [*PAGES, (None, "http://a/none", LONG), (None, None, None)]
    assert run(pages, extra=True) == brute(pages)


def test_no_pages(run):
    assert run([]) == []


def test_normalised_archives_are_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "crawl"), per_file=4)
    index = warc.normalise(spark, str(tmp_path / "crawl"), str(tmp_path / "new")).collect()
    crawl = {p.name: p for p in (tmp_path / "crawl").glob("*.gz")}
    assert sum(len(list(warc.split_records(p.read_bytes()))) for p in crawl.values()) == len(PAGES) == len(index)
    for folder in (tmp_path / "new").glob("archive=*"):
        (file,) = folder.glob("*.txt")
        content, source = file.read_bytes(), crawl[folder.name.removeprefix("archive=")]
        assert gzip.decompress(content) == gzip.decompress(source.read_bytes())
        entries = sorted((r.offset, r.length) for r in index if r.archive == source.name)
        records = [gzip.decompress(content[a : a + n]) for a, n in entries]
        assert records == list(warc.split_records(source.read_bytes()))


def test_broken_archives_are_refused():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.split_records(gzip.compress(record * 3))) == [record] * 3
    assert list(warc.split_records(gzip.compress(record) + gzip.compress(record))) == [record] * 2
    assert list(warc.split_records(b"")) == []
    with pytest.raises(ValueError):
        list(warc.split_records(gzip.compress(record[:-5])))
    with pytest.raises(ValueError):
        list(warc.split_records(gzip.compress(record * 100)[:-20]))
    with pytest.raises(ValueError):
        list(warc.split_records(gzip.compress(b"nonsense\r\n\r\n")))


def test_member_states_its_length():
    packed = warc.member(b"x" * 1000)
    assert gzip.decompress(packed + warc.EMPTY_MEMBER) == b"x" * 1000
    assert int.from_bytes(packed[16:20], "little") == len(packed)
