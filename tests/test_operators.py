"""Small frames: nulls, ties, empties, boundaries, and brute force where SQL is too slow."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlens.catalog import QUERIES
from postlens.functions import columns as C
from postlens.functions import text as X
from postlens.operators import boilerplate as B
from postlens.operators import dedup as D
from postlens.operators import lifecycle as L
from postlens.operators import places, quality, recover, salary, skills, vectors
from postlens.operators import relational as R
from postlens.operators.experience import classify_experience, extract_years
from postlens.plans import company, market, scores
from postlens.sources import feeds, pages, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("text,lo,hi,period", [
    ("What we pay: $71-88K", 71000, 88000, "year"),
    ("The salary lies between $48,250.00 and $63,900.00", 48250, 63900, "year"),
    ("You earn $19.75 – $31 an hour, paid weekly wage", 19.75, 31, "hour"),
    ("Salary: $101.300,00 - $117.800,00 per year", 101300, 117800, "year"),
    ("The pay has a minimum $52,000 and maximum $67,500", 52000, 67500, "year"),
    ("For this seat the salary is $83K", 83000, 83000, "year"),
    ("Investors gave the firm $45M last spring", None, None, None),
    ("The salary is $3 - $4 per year", None, None, None),
    ("Nothing about money", None, None, None),
    ("Our pay range: $131,000 ~ $158,500", 131000, 158500, "year"),
    ("For staff in Ohio: $92,000/year to $118,000/year", 92000, 118000, "year"),
    ("The pay range is CAD $61,000 - CAD $74,500", 61000, 74500, "year"),
    ("Step two pay: $54,210.40 (minimum) - $66,105.00 (midpoint) - $78,940.80 (maximum)", 54210.4, 78940.8, "year"),
    ("Expect a salary of $88,000 OTE - $104,000 OTE", 88000, 104000, "year"),
    ("A salaried post from the first day at $175,000+", 175000, 175000, "year"),
    ("We pay $98,000- 112,000K", 98000, 112000, "year"),
    ("The yearly bonus can come to $7,000 - $15,500.", None, None, None),
    ("Your equity grant is worth $30,000 - $55,000 when vested.", None, None, None),
    ("The salary range is $87-$109 annually.", 87000, 109000, "year"),
    ("Pay range here: $96 - $118 USD", 96000, 118000, "year"),
    ("The hourly salary range is $61 - $84", 61, 84, "hour"),
    ("Each rep carries $15K-$35K ARR accounts. The salary range: $76,000-$93,000 annually.", 76000, 93000, "year"),
    ("A $118k+ annual salary comes with the job", 118000, 118000, "year"),
    ("The salary will begin at $133,000 and up to $171,000.", 133000, 171000, "year"),
    ("OTE is $71,200 with a base salary at $44,600.", 44600, 71200, "year"),
    ("Pay of up to $68,000 for the right person", 68000, 68000, "year"),
    ("Our pay range: $17.45 - $23.60", 17.45, 23.6, "hour"),
])
def test_salary_forms(spark, text, lo, hi, period):
    got = one(spark, salary.extract_salary(F.col("t")), t=text)
    assert (None if got is None else (got.lo, got.hi, got.period)) == (None if lo is None else (lo, hi, period))


@pytest.mark.parametrize("text,req,pref", [
    ("Requirements: 6+ years of experience. Preferred: 9 years of experience", 6, 9),
    ("The person we want has 2-4 years of relevant experience", 2, None),
    ("Our shops have been open for over 60 years", None, None),
    ("You bring at least 7 years working in logistics", 7, None),
    ("Minimum Qualifications A trade certificate and a minimum of 3 years of related experience. Preferred Qualifications 6 years of experience.", 3, 6),
    ("Preferred Qualifications 2 years of experience. Minimum Qualifications 5 years of experience.", 5, 2),
    ("Requirements\n- 2 years of experience. Report to senior managers every month.", 2, None),
    ("Basic Qualifications 3+ years of professional experience.", 3, None),
    ("What you'll need 8 years of relevant experience.", 8, None),
    ("Requirements You have 4+ years working with looms and dyes.", 4, None),
    ("Requirements: 7 years of experience, 90 years old company", 7, None),
    ("For over 45 years we have moved freight. Plan routes for drivers.", None, None),
    ("We require 6 years of experience. Our team has 2 years of experience.", 6, None),
    ("Requirements\n- 4 years of experience\nWe have 9 years of experience in freight.", 4, None),
    ("Our role needs 3 years of experience.", 3, None),
    ("", None, None),
])
def test_years(spark, text, req, pref):
    got = one(spark, extract_years(F.col("t")), t=text)
    assert (got.required_years, got.preferred_years) == (req, pref)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_read_once_a_distinct_text(spark):
    df = spark.createDataFrame([(1, "Porto", None), (2, "Porto", None), (3, None, "remote"), (4, None, None), (5, "Paris, TX", "remote")], "id int, raw string, w string")
    out = places.normalize_locations(df, "raw", "w", places.gazetteer(spark))
    assert sorted((r.id, r.place.country, r.place.is_remote) for r in out.collect()) == [(1, "foreign", False), (2, "foreign", False), (3, "unknown", True), (4, "unknown", False), (5, "US", True)]
    # The patterns run below the join, on distinct texts.
    plan = optimized(out)
    assert plan.index("Join") < plan.index("work from home") and plan.count("work from home") == 1


def test_lines_that_cannot_be_a_company_are_not_searched_further(spark):
    df = spark.createDataFrame([("Nordwind Labs\nData Engineer\nAustin, TX\nwe ship software",), ("no name here at all\nnor here",)], "d string")
    out = recover.recover_dims(df, "d").select("company", "title", "city")
    assert [r[:] for r in out.collect()] == [("Nordwind Labs", "Data Engineer", "Austin"), (None, None, None)]
    # Signals for a company are asked twice (to leave lines out, and in the score), those against it once.
    plan = optimized(out)
    assert plan.count("gmbh") == 2 and plan.count("promoted") == 1


def test_honesty_reads_a_text_before_the_joins(spark):
    long = " Much is said here of the work to be done every day, and of those who do it with us, so the text is long enough."
    body = ["On-CALL with a Lean Team, FAST-paced. COMPETITIVE pay, 5+ years." + long, "You are a Rock Star and a NINJA, a self-starter, in OFFICE." + long, "Nothing." + long]
    p = spark.createDataFrame([(f"J{i}", "R", None, "raw", "remote", 90000, 100000, "year", 1, b) for i, b in enumerate(body)], "job_id string, role_id string, experience_level string, status string, workplace_type string, salary_min long, salary_max long, salary_period string, data_tier int, description_text string")
    fit = spark.createDataFrame([], "job_id string, level_bucket string, required_skills long, plausibility_penalty int, plausibility_flags array<string>")
    out = scores.honesty_score(p, None, spark.createDataFrame([("R", "Clerk")], "role_id string, role_name string"), fit)
    assert sorted((r.job_id, r.honesty_score, r.flags) for r in out.collect()) == [
        ("J0", 70, ["doe_competitive", "years_requirement", "oncall_lean_fastpaced"]), ("J1", 81, ["remote_but_onsite_language"]), ("J2", 100, [])]
    plan = optimized(out)
    assert plan.count("|commensurate)") == 1 and plan.rindex("Join") < plan.index("|commensurate)")


def test_monthly_skills_are_told_apart_after_the_shuffle_by_posting(spark):
    plan = QUERIES["bi_19_skill_monthly_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "l_orderkey" in line and "FileScan" in line)
    above = [line for line in plan[:scan] if "HashAggregate" in line or "Exchange hashpartitioning" in line or "REPARTITION" in line]
    assert "Exchange hashpartitioning(job_id" in above[-1] and "HashAggregate" in above[-2]


def test_monthly_skills_weigh_repeated_rows_and_leave_out_missing_pay(spark):
    p = spark.createDataFrame([("a", "2001-05-03", 10, "year"), ("b", "2001-05-09", 40, "year"), ("c", "2001-05-09", None, "year"), ("d", "2001-05-09", 70, "hour")], "job_id string, d string, salary_min long, salary_period string")
    p = p.select("job_id", F.col("d").cast("date").alias("date_found"), F.lit(None).cast("string").alias("experience_level"), "salary_min", F.lit(None).cast("long").alias("salary_max"), "salary_period")
    tags = spark.createDataFrame([("a", "s", None), ("a", "s", "Required"), ("b", "s", "required"), ("c", "s", "required"), ("d", "s", "required"), ("d", "u", "required")], "job_id string, skill_id string, skill_priority string")
    out = market.skill_monthly(p, tags, "2001-08-01", "found")
    assert sorted((r.skill_id, r.jobs_count, r.avg_salary_min, r.avg_salary_max) for r in out.collect()) == [("s", 4, 20.0, None), ("u", 1, None, None)]


def test_years_read_a_text_once(spark):
    df = spark.createDataFrame([("Requirements\t \r\n- 4  years of experience\f\u0001 here",)], "d string")
    read = df.select(extract_years(F.col("d")).alias("y")).select("y.*")
    assert read.first()[:] == (4, None, True)
    assert optimized(read).count("(?=\u0001)") == 1


def test_scope_of_work_and_title_are_read_once(spark):
    df = spark.createDataFrame([("Analyst  II", "You manage a team of four. Needs 6 years of experience.")], "t string, d string")
    out = classify_experience(df, "t", "d", extract_years(F.col("d"))).select("title_signal", "level", "required_years", "management_level", "conflicts")
    assert out.first()[:] == ("title_level_ii", "mid", 6, "people_manager", ["title_mid_vs_required_senior"])
    plan = optimized(out)
    assert plan.count("(?:direct reports") == 1 and plan.count("(?=\u0001)") == 1 and plan.count("lower(t") == 1


def test_headed_rows_are_spread(spark):
    assert "Repartition" in optimized(QUERIES["txt_4_years_by_heading"](spark, "/root/testdata/sf0.001"))



@pytest.mark.parametrize("raw,work,city,state,country,remote", [
    ("Austin, TX", None, "Austin", "TX", "US", False), ("Remote", None, None, None, "unknown", True), ("Remote - US", None, None, None, "US", True),
    ("Bangalore, IN", None, "Bangalore", None, "foreign", False), ("Gary, IN", None, "Gary", "IN", "US", False), ("Toronto, ON", "remote", "Toronto", None, "foreign", True),
    ("New York, New York, United States", None, "New York", "NY", "US", False), ("", None, None, None, "unknown", False),
    ("Austin, TX; Denver, CO", None, "Austin", "TX", "US", False), ("US-CA-San Diego", None, "San Diego", "CA", "US", False), ("Seattle, WA", None, "Seattle", "WA", "US", False),
    ("Dublin, OH, United States", None, "Dublin", "OH", "US", False), ("Remote, United States", "remote", None, None, "US", True),
    ("Paris, TX", None, "Paris", "TX", "US", False), ("Dublin, OH", None, "Dublin", "OH", "US", False), ("London, KY", None, "London", "KY", "US", False), ("Manchester, New Hampshire", None, "Manchester", "NH", "US", False),
    ("Dublin, CA", None, "Dublin", None, "foreign", False), ("San Francisco Bay Area", None, "San Francisco", "CA", "US", False), ("NYC", "hybrid", "New York", "NY", "US", False), ("Porto", None, "Porto", None, "foreign", False),
    ("Austin TX", None, "Austin", "TX", "US", False), ("Paris", None, "Paris", None, "foreign", False), ("Nowhere Special", None, "Nowhere Special", None, "unknown", False),
])
def test_places(spark, raw, work, city, state, country, remote):
    df = spark.createDataFrame([(raw, work)], "r string, w string")
    got = df.select(places.normalize_location(F.col("r"), F.col("w")).alias("p")).first().p
    assert (got.city, got.state, got.country, got.is_remote) == (city, state, country, remote)


def test_gazetteer_agrees_and_takes_the_longest_name(spark):
    rows = [("Paris, TX",), ("Bangalore, IN",), ("New London",), ("London",), ("Greater Boston",), ("a flat in Novi Sad",), ("NYC",), (None,), ("",), ("Remote",), ("Paris, TX",)]
    df = spark.createDataFrame(rows, "raw string").withColumn("w", F.lit(None).cast("string"))
    got = [(r.raw, r.place.city, r.place.country) for r in places.normalize_locations(df, "raw", "w", places.gazetteer(spark)).collect()]
    assert sorted(got, key=str) == sorted([("Paris, TX", "Paris", "US")] * 2 + [("Bangalore, IN", "Bangalore", "foreign"), ("New London", "New London", "US"), ("London", "London", "foreign"), ("Greater Boston", "Boston", "US"),
                                          ("a flat in Novi Sad", "a flat in Novi Sad", "foreign"), ("NYC", "New York", "US"), (None, None, "unknown"), ("", None, "unknown"), ("Remote", None, "unknown")], key=str)
    own = spark.createDataFrame([("springfield", True, None, None)], "name string, foreign boolean, city string, state string")
    hits = {r.raw: r.hit for r in places.find_places(spark.createDataFrame([("Springfield!",), ("x",)], "raw string"), "raw", own).collect()}
    assert list(hits) == ["Springfield!"] and hits["Springfield!"].abroad


@pytest.mark.parametrize("raw", ["Montréal", "Ljubljana", "Cebu", "Da Nang", "Taoyuan", "Ciudad de México", "Villeneuve d'Ascq", "SRB - Novi Sad", "Rockstar Dundee", "Remote, Canada"])
def test_places_abroad(spark, raw):
    assert one(spark, places.normalize_location(F.col("r"), F.lit(None).cast("string")), r=raw).country == "foreign"


def test_dates_never_invented(spark):
    df = spark.createDataFrame([(s,) for s in ["2026-01-02", "January 2, 2026", "1767312000", "2026-02-30", "soon", None]], "s string")
    got = [r[0] for r in df.select(C.parse_posted_date(F.col("s"))).collect()]
    assert got[:3] == [dt.date(2026, 1, 2)] * 3 and got[3:] == [None] * 3


def test_latest_before_is_strict_and_crosses_buckets(spark):
    rows = [(1, "a", "gone", dt.datetime(2024, 1, 1)), (2, "a", "back", dt.datetime(2024, 1, 1)), (3, "a", "back", dt.datetime(2024, 5, 1)), (4, "b", "back", dt.datetime(2024, 5, 1))]
    df = spark.createDataFrame(rows, "id int, k string, kind string, at timestamp")
    out = R.latest_before(df, "k", "at", F.col("kind") == "gone", ["id"], F.date_trunc("month", "at"))
    assert {r.id: r.prior_id for r in out.collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_global_rank_is_a_permutation(spark):
    got = R.global_rank(spark.range(1000), "id", "n").select("n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1001))


def test_hot_key_top_k(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    out = R.top_per_group(df, ["k"], [F.col("id").desc()], 2).filter("k = 0").collect()
    assert sorted(r.id for r in out) == [2994, 2997]


def _clusters(texts, threshold):
    def sh(t):
        w = t.split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {t}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    sets = [sh(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("threshold", [0.995, 0.95])
def test_near_dups_match_brute_force(spark, threshold):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([20, 90, 260, 900]))]
        for edits in (0, 0, 1, 2, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("b", F.lit("x"))
    got = {r.id: r.cluster_id for r in D.near_dup_clusters(df, "id", ["b"], "body", threshold).collect()}
    assert [got[i] for i in range(len(texts))] == _clusters(texts, threshold)


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in D.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[300] == 0 and got[1199] == 1000 and len(set(got.values())) == 2


def test_boilerplate_found_and_removed(spark):
    shared = "we value every applicant and offer the same benefits to all of our staff in every single office around the world today " * 2
    rows = [(i, "c", f"Role {i} is about thing{i} number {i * 7}. " * 3 + shared) for i in range(4)] + [(9, "d", shared)]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    found = B.find_boilerplate(df, "g", "t")
    assert {r.g for r in found.collect()} == {"c"}
    out = {r.id: r.stripped_text for r in B.strip_boilerplate(df, found, "id", "g", "t").collect()}
    assert "thing2" in out[2] and len(out[2]) < len(rows[2][2]) * 0.7 and out[9].startswith("we value")


def test_text_without_an_anchor_keeps_its_blanks(spark):
    """Three words of a chunk bring it to a text, its anchor alone cuts there."""
    chunk = "about company 127. we value every applicant and offer the same benefits to all staff"
    rows = [(1, "c", "Intro\nWe offer\tcompany 127. we other things."), (2, "c", f"A first line.\n{chunk} in every office of the whole group, at home and abroad.\nThe rest, which is long enough to stay."), (3, "c", None)]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    found = spark.createDataFrame([("c", chunk, 3)], "g string, chunk string, docs long")
    out = {r.id: r.stripped_text for r in B.strip_boilerplate(df, found, "id", "g", "t").collect()}
    assert out[1] == rows[0][2] and out[2].startswith("A first line.") and "\n" not in out[2] and "value every" not in out[2] and out[3] == ""


def test_boilerplate_is_cut_without_a_row_for_each_word(spark):
    """A group's chunks meet its texts as one list; blanks in a row move no cut."""
    chunk = "we value every applicant and offer the same benefits to all staff"
    rows = [(1, "c", f" Intro  here.\n\n{chunk.replace(' ', '  ')} in every office of the group and more than that.  The rest\tstays."), (2, "d", f"{chunk} too")]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    out = B.strip_boilerplate(df, spark.createDataFrame([("c", chunk, 3)], "g string, chunk string, docs long"), "id", "g", "t")
    got = {r.id: r.stripped_text for r in out.collect()}
    start = rows[0][2].index("we  value")
    assert got == {1: " ".join((rows[0][2][:start] + rows[0][2][start + len(chunk) + B.MARGIN:]).split()), 2: rows[1][2]}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_encoded_rows_have_length_one(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, None), (3, "...")], "id int, t string").coalesce(1)
    raw = {r.id: r.vector for r in vectors.encode_texts(df, "t", vectors.HashedTokens(), unit=False, batch=2).collect()}
    unit = {r.id: r.vector for r in vectors.encode_texts(df, "t", vectors.HashedTokens(), batch=2).collect()}
    assert sorted(x for x in raw[1] if x) == [1.0, 2.0] and len(raw[1]) == 256 and not any(raw[2]) and not any(raw[3])
    assert unit[1] == pytest.approx([x / 5 ** 0.5 for x in raw[1]]) and not any(unit[2]) and not any(unit[3])


def test_shingles_split_a_text_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, None), (4, "x  x x x x x x"), (5, "b c d e f"), (6, "a b a")], "id int, t string").select("id", D.shingles(F.col("t")).alias("s"), "t")
    got = {r.id: r.s for r in df.collect()}
    assert got[3] is None and [len(got[i]) for i in (1, 2, 4, 5, 6)] == [2, 1, 1, 1, 1]
    assert got[1][1] == got[5][0] and len({got[i][0] for i in (1, 2, 4, 5, 6)}) == 5
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_sweep_keeps_days_of_zeros_among_covered_ones(spark):
    """A company's days come out of the sums themselves, with nothing joined to them."""
    day = lambda d: dt.date(2001, 8, d)
    last, names = F.lit("2001-08-06").cast("date"), ["open", "_covered", "_since"]
    spans = spark.createDataFrame([("a", day(3), day(4)), ("a", day(3), day(3)), ("b", day(1), day(1))], "k string, lo date, hi date")
    cover = spark.createDataFrame([("a", day(2), day(6), dt.date(1969, 12, 30))], "k string, lo date, hi date, s date")
    changes = company.edges(spans, ["k"], {"open": F.lit(1)}, names).unionByName(company.edges(cover, ["k"], {"_covered": F.lit(1), "_since": F.unix_date("s")}, names))
    out = company.sweep(changes, ["k"], names, last, among="_covered")
    assert sorted((r.k, r.snapshot_date.day, r.open, r["_since"]) for r in out.collect()) == [("a", d, n, -2) for d, n in zip(range(2, 7), (0, 2, 1, 0, 0))]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_counts_leave_out_texts_without_a_token(spark):
    from postlens.catalog.match_queries import bucket_counts

    rows = spark.createDataFrame([("a", [0.0, 2.0, 1.0]), ("b", [0.0, 0.0, 0.0])], "job_id string, vector array<float>")
    assert [(r.job_id, r.tokens, r.squares) for r in bucket_counts(rows).collect()] == [("a", 3, 5)]


def test_sections_rule_priority(spark):
    text = "We use go daily\nRequirements:\n- python and big data\nNice to have\n- spark\nBenefits\n- python lessons"
    df = spark.createDataFrame([("j", text)], "job_id string, t string")
    names = spark.createDataFrame([("python", 1, False), ("spark", 2, False), ("go", 3, True), ("big data", 4, False)], "alias string, skill_id int, ambiguous boolean")
    got = {r.skill_id: r.skill_priority for r in skills.extract_skills_sectioned(df, "job_id", "t", names).collect()}
    assert got == {1: "required", 2: "nice-to-have", 4: "required"}


def test_knn_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    items, queries = rng.normal(size=(120, 8)), rng.normal(size=(9, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    got = {}
    for r in vectors.knn(q, c, 5).collect():
        got.setdefault(r.query_id, []).append((r.place, r.item_id))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit(queries) @ unit(items).T), axis=1)[:, :5]
    assert all([i for _, i in sorted(got[k])] == want[k].tolist() for k in range(9))


def test_ties_keep_exactly_k_in_key_order(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(99, [0.9, 0.1])], "item_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert sorted(r.item_id for r in vectors.knn(q, c, 3).collect()) == [0, 1, 2]


def encoded(spark):
    """Queries and items whose vectors come from the encoder, so both ways to unit length meet."""
    texts = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 3 + i % 9))) for i in range(60)]
    items = vectors.encode_texts(spark.createDataFrame(texts, "item_id long, t string"), "t", vectors.HashedTokens(dims=32)).select("item_id", "vector").localCheckpoint()
    rows = {r.item_id: [float(x) for x in r.vector] for r in items.collect()}
    return items.filter("item_id % 10 = 0").withColumnRenamed("item_id", "query_id"), items, rows


def nearest(rows, q):
    return sorted((-round(sum(x * y for x, y in zip(rows[q], v)) / sum(x * x for x in rows[q]) ** 0.5 / sum(x * x for x in v) ** 0.5, 9), i) for i, v in rows.items())


def test_knn_of_encoded_texts(spark):
    queries, items, rows = encoded(spark)
    got = sorted((r.query_id, r.place, -round(r.similarity, 6)) for r in vectors.knn(queries, items, 4).collect())
    assert got == [(q, place, round(s, 6)) for q in range(0, 60, 10) for place, (s, _) in enumerate(nearest(rows, q)[:4], 1)]


def test_prefiltered_knn_of_encoded_texts(spark):
    queries, items, rows = encoded(spark)
    got = sorted((r.query_id, r.place, -round(r.similarity, 6)) for r in vectors.knn(queries, items, 4, prefilter=20, eligible=items.filter("item_id % 3 <> 0")).collect())
    want = {q: [s for s, i in nearest(rows, q)[:20] if i % 3][:4] for q in range(0, 60, 10)}
    assert got == [(q, place, round(s, 6)) for q, best in want.items() for place, s in enumerate(best, 1)]


def test_ann_of_encoded_texts(spark):
    queries, items, rows = encoded(spark)
    got = sorted((r.query_id, r.place, -round(r.similarity, 6)) for r in vectors.ann(queries, items, 4, least=60).collect())
    assert got == [(q, place, round(s, 6)) for q in range(0, 60, 10) for place, (s, _) in enumerate(nearest(rows, q)[:4], 1)]


def test_recall_of_codes_is_measured(spark):
    rows = QUERIES["mat_2_ann_recall"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.wanted == 20 and r.enough_found and r.few_scored and r.scores_agree for r in rows)


def test_block_join_covers_the_grid(spark):
    import pandas as pd

    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(70).withColumnRenamed("id", "y")
    cell = lambda p, q: pd.DataFrame({"n": [len(p) * len(q)]})
    assert vectors.block_join(a, b, "x", "y", cell, "n long", left_block=7, right_block=9).agg(F.sum("n")).first()[0] == 3500


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "u1", "L1"), (2, "b", "u2", "L2"), (3, "c", "u3", "L3")], "k int, v string, url string, lvl string")
    new = spark.createDataFrame([(1, None, "u1", None), (2, None, "changed", None), (4, "d", "u4", "L4")], "k int, v string, url string, lvl string")
    got = {r.k: (r.v, r.url, r.lvl) for r in sinks.upsert(old, new, ["k"], {"v": "coalesce", "lvl": ("reset", "url")}).collect()}
    assert got == {1: ("a", "u1", "L1"), 2: ("b", "changed", None), 3: ("c", "u3", "L3"), 4: ("d", "u4", "L4")}


def test_snapshot_and_swap(spark, tmp_path):
    path = str(tmp_path / "snap")
    frame = lambda rows: spark.createDataFrame(rows, "v int, snapshot_date string")
    sinks.write_snapshot(frame([(1, "d1"), (2, "d2")]), path)
    sinks.write_snapshot(frame([(9, "d2")]), path)
    assert sorted((r.v, str(r.snapshot_date)) for r in spark.read.parquet(path).collect()) == [(1, "d1"), (9, "d2")]
    table = str(tmp_path / "t")
    assert sinks.swap_table(spark.range(3), table) == 3 and sinks.swap_table(spark.range(5), table) == 5
    with pytest.raises(RuntimeError):
        sinks.swap_table(spark.range(0), table)
    assert sinks.read_current(spark, table).count() == 5
    held = sinks.read_current(spark, table)
    sinks.swap_table(spark.range(7), table)
    assert held.count() == 5 and sinks.read_current(spark, table).count() == 7


def test_feed_conserves_rows(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"jobs":[{"id":"1","title":"Data Engineer","posted_date":"2026-01-02"},{"id":"1","title":"Data Engineer","posted_date":"2026-01-03"},'
                                     '{"title":"Data Analyst"},{"id":"3","title":"Cook"},{"id":"4","title":"Analyst","posted_date":"never"}]}')
    good, bad, stats = feeds.read_partner_feed(spark, str(tmp_path / "f.json"), "json", "Acme", "acme")
    assert [(r.source_id, str(r.posted_date)) for r in good.collect()] == [("acme|1", "2026-01-03")]
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad_date", "missing_id"]
    assert stats.agg(F.sum("n")).first()[0] == 5
    (tmp_path / "f.csv").write_text('title,id,posted_date\n"Data, Engineer",7,2026-01-02\nAnalyst,,\n')
    good, bad, _ = feeds.read_partner_feed(spark, str(tmp_path / "f.csv"), "csv", "Acme", "acme")
    assert [r.title for r in good.collect()] == ["Data, Engineer"] and bad.count() == 1
    (tmp_path / "f.jsonl").write_text('{"id":"1","title":"Data Engineer"}\n{broken\n')
    good, bad, _ = feeds.read_partner_feed(spark, str(tmp_path / "f.jsonl"), "jsonl", "Acme", "acme")
    assert good.count() == 1 and [r.reject_reason for r in bad.collect()] == ["unreadable"]


def test_jsonld_of_any_depth(spark):
    inner = '{"@type":"JobPosting","title":"deep"}'
    for _ in range(6):
        inner = '{"@graph":[%s,{"@type":"Thing"}]}' % inner
    df = spark.createDataFrame([(1, '<script type="application/ld+json">%s</script>' % inner)], "page_id int, html string")
    assert [r.title for r in pages.extract_jsonld(df).collect()] == ["deep"]


def test_sitemaps_of_any_depth_and_loops(spark):
    xml = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    docs = [(f"m{i}", xml(f"m{i + 1}", f"https://x/jobs/{i}")) for i in range(6)] + [("m6", xml("m0", "m6", "https://x/jobs/last", "https://x/blog/1"))]
    out = pages.expand_sitemaps(spark.createDataFrame(docs, "url string, xml string"), spark.createDataFrame([("m0",)], "url string"))
    assert sorted(r.url for r in out.collect()) == sorted([f"https://x/jobs/{i}" for i in range(6)] + ["https://x/jobs/last"])


def test_aliases_of_any_length(spark):
    aliases = spark.createDataFrame([("one two three four five six", "S1", False), ("two", "S2", False)], "alias string, skill_id string, ambiguous boolean")
    texts = spark.createDataFrame([(1, "say one two three four five six now"), (2, "one two three four five"), (3, "nothing")], "id int, t string")
    got = skills.match_aliases(texts, ["id"], F.col("t"), aliases).select("id", "skill_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, "S1"), (1, "S2"), (2, "S2")]


def test_entities_are_decoded(spark):
    assert one(spark, X.dedup_normalize(F.col("t")), t="Say &quot;hi&quot; &amp; it&#39;s <b>done</b>") == "say hi it s done"


def test_jsonld_shapes(spark):
    tag = '<script type="application/ld+json">%s</script>'
    html = tag % '{"@type":"JobPosting","title":"A"}' + tag % "{broken" + tag % '[{"@type":["Thing","JobPosting"],"title":"B"},{"@graph":[{"@type":"JobPosting","title":"C"}]}]'
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    assert sorted(r.title for r in pages.extract_jsonld(df).collect()) == ["A", "B", "C"]


def test_publish_refuses_a_shrinking_set(spark):
    posts = spark.createDataFrame([(str(i), "r", True) for i in range(10)], "job_id string, role_id string, is_public boolean")
    roles = spark.createDataFrame([("r", "Data Engineer")], "role_id string, role_name string")
    with pytest.raises(quality.PublicationRefused):
        quality.publish(posts, posts.limit(6), roles, minimum=1)
    run = quality.publish(posts, posts.filter("job_id <> '3'"), roles, minimum=1)["run"].first()
    assert (run.prior_count, run.activated, run.deactivated) == (10, 0, 1)


def test_alert_thresholds(spark):
    day, before = dt.date(2024, 3, 8), dt.date(2024, 3, 1)
    rows = [(d, c, "all", n, new, rep, dt.date(2024, 1, 1)) for d, c, n, new, rep in [
        (before, "up", 8, 0, 0), (day, "up", 11, 4, 0), (before, "flat", 20, 0, 0), (day, "flat", 23, 5, 1), (day, "rep", 1, 0, 2)]]
    radar = spark.createDataFrame(rows, "snapshot_date date, company_id string, scope string, active_opportunities long, new_opportunities_7d long, individual_repost_signals_30d long, coverage_started_at date")
    follows = spark.createDataFrame([("u", c, "daily") for c in ("up", "flat", "rep")] + [("v", "up", "none")], "user_id string, company_id string, alert_frequency string")
    got = company.radar_alerts(radar, follows, "2024-03-08")
    assert {(r.company_id, r.alert_type) for r in got.collect()} == {("up", "hiring_surge"), ("flat", "fresh_roles"), ("rep", "repost_watch")}
    assert company.radar_alerts(radar, follows, "2024-03-08", got).count() == 0


def test_lifecycle_stream_in_two_batches(spark, tmp_path):
    from postlens.streaming import events as S

    path = str(tmp_path / "in")
    schema = "job_id string, observed_at timestamp"
    frame = lambda rows: spark.createDataFrame([(j, dt.datetime(2024, 1, d, h)) for j, d, h in rows], schema)
    frame([("a", 1, 1), ("a", 1, 3), ("b", 1, 2)]).coalesce(1).write.parquet(path)
    frame([("b", 5, 1)]).coalesce(1).write.mode("append").parquet(path)
    frame([("a", 9, 1)]).coalesce(1).write.mode("append").parquet(path)
    out = S.run_to_table(S.lifecycle_stream(S.event_stream(spark, path, schema, files_per_trigger=1)), "t")
    got = [(r.job_id, r.event_type) for r in out.orderBy("observed_at", "event_type").collect()]
    assert got.count(("a", "appeared")) == 1 and ("a", "disappeared") in got and ("a", "reappeared") in got


def test_merge_outcomes_algebra(spark):
    rows = [("s", "t1", "failed", 0), ("s", "t1", "complete_zero", 4), ("s", "t2", "failed", 0), ("s", "t3", "complete_zero", 0), ("s", "t3", "complete_nonzero", 3)]
    df = spark.createDataFrame([(*r, 1, "d", i, i) for i, r in enumerate(rows)], "source string, crawl_tenant string, status string, jobs_fetched int, errors int, detail string, started_on int, run_id int")
    assert {r.crawl_tenant: r.status for r in L.merge_outcomes(df).collect()} == {"t1": "partial_failure", "t2": "failed", "t3": "complete_nonzero"}


def test_normalisers_are_idempotent(spark):
    df = spark.createDataFrame([("<p>A &amp; B 12</p> https://x.y/z", "Café  & Co.")], "t string, n string")
    once = df.select(X.dedup_normalize(F.col("t")).alias("t"), C.slug(F.col("n")).alias("n"))
    twice = once.select(X.dedup_normalize(F.col("t")).alias("t"), C.slug(F.col("n")).alias("n"))
    assert once.first() == twice.first() and once.first().n == "cafe-and-co"


def test_recover_fills_only_gaps(spark):
    df = spark.createDataFrame([("Given", "Acme Corp logo\nApply now\nData Engineer\nAustin, TX\ntext")], "title string, t string")
    got = recover.recover_dims(df, "t").first()
    assert (got.title, got.company, got.city, got.state) == ("Given", "Acme Corp", "Austin", "TX")


def test_scratch_folders_can_be_cleared(spark):
    from postlens.session import clear_scratch, scratch_path

    clear_scratch(spark)
    path = scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clear_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
