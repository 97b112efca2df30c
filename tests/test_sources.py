"""Readers, brand attribution, candidate pairs, streams with late rows: small frames against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import dedup as D
from postlens.operators import matching as M
from postlens.operators import skills
from postlens.plans import company as K
from postlens.plans import ops as O
from postlens.sources import pages
from postlens.streaming import events as S


def test_dump_is_read_by_many_tasks(spark, tmp_path):
    blocks = [f"Block {i}\nwith two lines and some words" for i in range(400)]
    text = "noise before\n" + "\nnoise between\n".join(f"=== JOB START ===\n{b}\n=== JOB END ===" for b in blocks + [b.upper() for b in blocks[:50]]) + "\n=== JOB START ===\ncut off"
    (tmp_path / "dump.txt").write_text(text * 1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = spark.read.option("lineSep", "=== JOB END ===").text(str(tmp_path))
        assert records.rdd.getNumPartitions() > 4
        got = sorted(r.block.lower() for r in pages.read_dump(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted([b.lower() for b in blocks] + ["cut off"])


def test_brand_owners_of_any_depth_and_circles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", None)], "brand string, parent string")
    got = sorted(map(tuple, pages.brand_owners(edges).collect()))
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")]


@pytest.mark.parametrize("org,url,expected", [
    ("Mill House", "https://jobs.other.example/1", "host"), ("Tiny Label", "https://jobs.other.example/1", "parent"), ("Loose Name", "https://www.mill.example/1", "brand"),
    ("Loose Name", "https://www.other.example/1", None), ("Bad Board", "https://www.mill.example/1", None), (None, "https://www.mill.example/1", None), (" ", "https://www.mill.example/1", None),
])
def test_attribution(spark, org, url, expected):
    edges = spark.createDataFrame([("tiny label", "big label"), ("big label", "mill house")], "brand string, parent string")
    rows = spark.createDataFrame([(org, url, "Mill House", "https://jobs.mill.example/careers")], "organization string, url string, company_name string, careers_url string")
    assert pages.attribute_brands(rows, edges, ["Bad Board"]).first().attribution == expected


def test_hubs_are_no_jobs(spark):
    docs = spark.createDataFrame([("m", "<urlset><loc>https://x/jobs/1</loc><loc>https://x/careers/eu/jobs/</loc><loc>https://x/careers</loc><loc>https://x/careers/search-jobs?q=1</loc><loc>https://x/position/jobs-lead/2</loc></urlset>")], "url string, xml string")
    roots = spark.createDataFrame([("m",)], "url string")
    assert sorted(r.url for r in pages.expand_sitemaps(docs, roots).collect()) == ["https://x/jobs/1", "https://x/position/jobs-lead/2"]


def test_block_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.sample([f"t{k}" for k in range(25)], rng.randint(1, 9))) for i in range(160)]
    rows += [(200 + i, "a", ["same", "words", "in", "all"]) for i in range(80)] + [(300, "a", ["same", "words", "in", "some"]), (301, "a", [])]
    df = spark.createDataFrame(rows, "id long, block string, t array<string>")
    for threshold in (0.3, 0.6):
        classes = {}
        for i, b, t in rows:
            if t:
                classes.setdefault((b, frozenset(t)), []).append(i)
        reps = [(b, s, min(ids), len(ids)) for (b, s), ids in classes.items()]
        want = []
        for b, s, i, n in reps:
            for c, u, j, m in reps:
                if b == c and i < j and len(s & u) >= threshold * len(s | u):
                    want.append((b, i, j, n, m, round(len(s & u) / len(s | u), 6)))
        got = [tuple(r) for r in D.block_pairs(df, "id", "block", F.col("t"), threshold).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 0


def test_block_pairs_of_long_sets_meet_without_them(spark, monkeypatch):
    """Sets of unlike length that share frequent words: pairs as brute force, and no set in the candidate join."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, "a", rng.sample(common, 40) + [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 60, 150]))]) for i in range(60)]
    rows += [(100 + i, "a", rows[i][2][: -rng.randint(1, 4)] + ["new"]) for i in range(40)] + [(200 + i, "b", rows[i][2]) for i in range(10)]
    want = [(i, j, round(len(set(s) & set(u)) / len(set(s) | set(u)), 6)) for i, b, s in rows for j, c, u in rows if b == c and i < j and 2 * len(set(s) & set(u)) >= len(set(s) | set(u))]
    cut, seen = D.cut_lineage, []
    monkeypatch.setattr(D, "cut_lineage", lambda df: seen.append(df.dtypes) or cut(df))
    got = D.block_pairs(spark.createDataFrame(rows, "id long, block string, t array<string>"), "id", "block", F.col("t"), 0.5)
    assert sorted((r.src, r.dst, r.similarity) for r in got.collect()) == sorted(want) and len(want) > 40
    assert not any(kind.startswith("array") for frame in seen[1:] for _, kind in frame)


def test_block_pairs_keep_no_candidates(spark, monkeypatch):
    """Sets that share rare tokens and are far from alike: what is written holds a row a set at most, whatever the cells look at."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b"]), [f"r{k}" for k in range(4)] + rng.sample([f"c{k}" for k in range(40)], 20)) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2][:-1] + [f"own{i}"]) for i in range(12)]
    want = {(i, j) for i, b, s in rows for j, c, u in rows if b == c and i < j and 5 * len(set(s) & set(u)) >= 4 * len(set(s) | set(u))}
    cut, written = D.cut_lineage, []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(D, "cut_lineage", counted)
    df = spark.createDataFrame(rows, "id long, block string, t array<string>")
    for room in (1 << 22, 512):  # one row of sets, and several that meet in cells
        got = D.block_pairs(df, "id", "block", F.col("t"), 0.8, room)
        assert {(r.src, r.dst) for r in got.collect()} == want and len(want) >= 6
    assert max(written) <= len(rows)


def test_cells_look_at_pairs_in_parts():
    from postlens.operators import set_cells as Z

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, rng.integers(3, 40))).astype(np.uint32) for _ in range(100)]
    sets = sorted([*sets, *(s[rng.random(len(s)) < 0.8] for s in sets[:50] if len(s) > 8)], key=len)
    often = np.zeros(1 << Z.SLOTS, np.uint32)
    for s in sets:
        often[s] += 1
    first, bits = Z.encoded(sets, often, 0.5)
    n = np.array([len(s) for s in sets], np.int64)
    row = {"who": {}, "words": b"", "ends": b"", "home": np.zeros(len(n), np.int64).tobytes(), "n": n.tobytes(), "first": b"".join(first), "bits": b"".join(bits)}
    block = Z.Block(row, 0.5)
    alike = {(i, j) for j in range(len(n)) for i in range(j) if 3 * len(np.intersect1d(sets[i], sets[j])) >= n[i] + n[j]}
    for room in (1 << 21, 40, 7):
        pairs = set(zip(*(x.tolist() for x in Z.meet(block, block, True, 0.5, room))))
        assert alike <= pairs and all(i < j for i, j in pairs) and len(alike) > 20


def test_late_rows_are_counted(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "event_id long, ts timestamp, event_type string, value double"
    first = [(i, at(i), "view", 1.0) for i in range(30)]
    second = [(100 + i, at(30 + i), "view", 1.0) for i in range(30)] + [(7, at(7), "view", 1.0)]
    third = [(200, at(3), "view", 1.0), (201, at(58.5), "view", 1.0), (129, at(59), "view", 1.0), (202, at(120), "view", 1.0)]
    rows, dropped = S.run_arrivals([spark.createDataFrame(p, schema) for p in (first, second, third)], S.event_counts, "late")
    assert dropped == 2  # the repeat of 7 and row 200
    assert {(r.window_start.day, r.n) for r in rows.collect()} == {(1, 24), (2, 24), (3, 13)}


def test_radar_spans_merge(spark):
    day = lambda d: dt.date(2024, 1, d)
    spans = spark.createDataFrame([("k", day(1), day(3)), ("k", day(2), day(2)), ("k", day(4), day(5)), ("k", day(8), day(9)), ("j", day(1), day(1))], "k string, lo date, hi date")
    assert sorted(map(tuple, K.islands(spans, ["k"]).collect())) == [("j", day(1), day(1)), ("k", day(1), day(5)), ("k", day(8), day(9))]
    changes = K.edges(spans, ["k"], {"n": F.lit(1)}, ["n"])
    got = {(r.k, r.snapshot_date.day): r.n for r in K.sweep(changes, ["k"], ["n"], F.lit(day(8))).collect()}
    assert got == {("k", 1): 1, ("k", 2): 2, ("k", 3): 1, ("k", 4): 1, ("k", 5): 1, ("k", 8): 1, ("j", 1): 1}


def test_report_state_by_group_and_of_nothing(spark):
    crawl = spark.createDataFrame([("a", "complete_nonzero"), ("b", "running"), ("c", "source_failure"), ("c", "running")], "source string, state string")
    published = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.source: r.state for r in O.report_state(crawl, published, "2024-01-02 00:00:00", by=["source"]).collect()}
    assert got == {"a": "Healthy", "b": "In progress", "c": "Needs attention"}
    assert O.report_state(crawl.limit(0), published, "2024-01-02 00:00:00").first().state == "Healthy"
    assert O.report_state(crawl.limit(0), published, "2024-01-02 13:00:00").first().state == "Needs attention"


@pytest.mark.parametrize("text,level,years,evidence", [
    ("Clerk\nMill, 02/2011 - 08/2012", "associate", 1.5, "dates"), ("Clerk\nMill, Feb 2011 to now", "senior", 9.0, "dates"), ("Clerk\nMill, 2011 - 2013", "associate", 2.0, "dates"),
    ("Senior clerk\nMill, 2016 - 2018", "associate", 2.0, "dates"), ("Senior clerk\nMill, 2012 - 2018", "senior", 6.0, "titles"), ("Senior clerk, lead clerk\nMill, 2017 - 2018", "senior", 1.0, "titles"),
    ("Trainee\nMill, 2001 - 2018", "entry", 17.0, "titles"), ("Trainee, then senior clerk", "mid", None, "titles"), ("Associate", "associate", None, "titles"), ("Mill, 2018 - 2016", "mid", None, "titles"),
    ("Mill, 1970 - 1999", "mid", None, "titles"), ("Head of mill with 2 years of experience", "associate", 2.0, "stated"), ("", "mid", None, "titles"),
])
def test_resume_levels(spark, text, level, years, evidence):
    row = M.resume_level(spark.createDataFrame([("u", text)], "resume_id string, resume_text string"), "2020-02-10").first()
    assert (row.level, row.years, row.evidence) == (level, years, evidence)


def test_ruling_words_on_headings_and_lines(spark):
    text = "About\nuses alpha\nYour required skills:\n- beta\n- gamma (preferred)\nWhat would be a bonus:\n- delta\n- epsilon is a must have\n- this line holds preferred zeta:\nBenefits\n- eta"
    names = spark.createDataFrame([(f"S{i}", n) for i, n in enumerate("alpha beta gamma delta epsilon zeta eta".split())], "skill_id string, skill_name string")
    got = {r.skill_id: r.skill_priority for r in skills.extract_skills_sectioned(spark.createDataFrame([("j", text)], "job_id string, t string"), "job_id", "t", skills.alias_table(names)).collect()}
    assert got == {"S0": "required", "S1": "required", "S2": "preferred", "S3": "nice-to-have", "S4": "required", "S5": "preferred", "S6": "required"}


def test_documents_of_one_address_count_once(spark):
    """A map in 200 documents that an index names in 50 was an edge 10,000 times over."""
    from postlens.operators.relational import distinct_in_parts

    rows = [("root", "<sitemapindex><loc>m</loc></sitemapindex>")] * 50 + [("m", f"<urlset><loc>https://x/jobs/{i}</loc></urlset>") for i in range(200)]
    held = []

    def cut(df):
        held.append(df.count())
        return df

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pages, "cut_lineage", cut)
        out = pages.expand_sitemaps(spark.createDataFrame(rows, "url string, xml string"), spark.createDataFrame([("root",)], "url string"))
    assert out.count() == 200 and held[0] == 250
    assert distinct_in_parts(spark.range(10).selectExpr("id % 3 AS k"), 10).count() == 3
