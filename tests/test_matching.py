"""Matching without a product: results against plain loops."""

import datetime as dt
import math
import random
from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import matching as M
from postlens.operators import vectors as V


def fixture(spark, seed=4, resumes=40, jobs=300, skills=14):
    rng = random.Random(seed)
    weights = [1 / (1 + i) for i in range(skills)]

    def some(low, high):
        return sorted({f"S{rng.choices(range(skills), weights)[0]}" for _ in range(rng.randint(low, high))})

    people = [(f"U{i}", rng.choice(["entry", "associate", "mid", "senior", "odd"]), rng.choice(["red", "blue", "none"]), some(1, 6)) for i in range(resumes)]
    posts = [(f"J{i:03d}", rng.choice(["red", "blue", None]), rng.choice(["entry", "mid", "senior", None]), rng.choice([None, 50.0, 60.0, 75.0]), some(1, 8)) for i in range(jobs)]
    r = spark.createDataFrame([p[:3] for p in people], "resume_id string, exp_level string, target_domain string")
    rs = spark.createDataFrame([(p[0], s) for p in people for s in p[3]], "resume_id string, skill_id string")
    j = spark.createDataFrame([p[:3] + (p[3], None) for p in posts], "job_id string, domain string, experience_level string, salary_max_annual double, salary_min_annual double")
    js = spark.createDataFrame([(p[0], s) for p in posts for s in p[4]], "job_id string, skill_id string")
    return people, posts, r, rs, j, js


def test_weighted_matches_against_all_pairs(spark):
    people, posts, r, rs, j, js = fixture(spark)
    worth = {(m, f"S{i}"): round(1 / (i + 2), 3) for m in ("red", "blue") for i in range(14)}
    w = spark.createDataFrame([(m, s, x) for (m, s), x in worth.items()], "domain string, skill_id string, weight double")
    for k in (3, 50, 1000):
        got = sorted(tuple(x) for x in M.weighted_job_matches(r, j, rs, js, w, k).collect())
        want = []
        for u, _, market, own in people:
            scored = []
            for job, m, _, _, wants in posts:
                total = math.floor(sum(worth.get((market, s), 0) for s in set(own) & set(wants)) * 1e6 + 0.5) / 1e6 if m == market else 0
                if total > 0:
                    scored.append((-total, job))
            want += [(u, job, -s, place) for place, (s, job) in enumerate(sorted(scored)[:k], 1)]
        assert got == sorted(want)


def test_skill_gaps_against_all_pairs(spark):
    people, posts, r, rs, j, js = fixture(spark, seed=9)
    number = {"entry": 0, "associate": 1, "mid": 2, "senior": 3}
    want = []
    for u, level, _, own in people:
        now, unlock, pays = [], Counter(), {}
        for job, _, jl, pay, wants in posts:
            a, b = number.get(level), number.get(jl)
            if a is not None and (b is None or abs(a - b) > 1):
                continue
            both, n = len(set(own) & set(wants)), len(wants)
            if 10 * both >= 7 * n:
                now.append(pay)
            if n >= 2 and both < n and 10 * both >= 7 * (n - 1):
                for s in set(wants) - set(own):
                    unlock[s] += 1
                    pays.setdefault(s, []).append(pay)
        mid = lambda xs: median(x for x in xs if x is not None) if any(x is not None for x in xs) else None
        rows = []
        for s, n in unlock.items():
            if n >= 3:
                a, b = mid(now), mid(pays[s])
                rows.append((-n, -(b - a if a is not None and b is not None else 0), s, a, b))
        want += [(u, s, -n, a, b, place) for place, (n, _, s, a, b) in enumerate(sorted(rows, key=lambda x: x[:3])[:5], 1)]
    got = [(x.resume_id, x.skill_id, x.unlock_count, x.current_median_salary, x.unlock_median_salary, x.place) for x in M.skill_gaps(r, j, rs, js).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20


def test_match_jobs_against_all_pairs(spark):
    people, posts, r, rs, j, js = fixture(spark, seed=21, jobs=420)
    rng = random.Random(8)
    floors = {p[0]: rng.choice([None, 40.0, 55.0, 62.0, 80.0, 100.0]) for p in people}
    more = {p[0]: (rng.choice([None, 40.0, 90.0, 0.35]), dt.date(2024, 1, rng.randint(1, 31)), rng.choice([None, 0.0, 52.5, 61.25, 70.0, 90.0])) for p in posts}
    r = r.join(spark.createDataFrame(list(floors.items()), "resume_id string, salary_floor double"), "resume_id")
    j = j.drop("salary_min_annual").join(spark.createDataFrame([(k, *v) for k, v in more.items()], "job_id string, honesty_score double, ingested_at date, salary_min_annual double"), "job_id")
    number = {"entry": 0, "associate": 1, "mid": 2, "senior": 3}
    want = []
    for u, level, _, own in people:
        scored = []
        for job, _, jl, high, wants in posts:
            honesty, seen, low = more[job]
            both, n = len(set(own) & set(wants)), len(wants)
            f1 = min(2.0 * both / (n + len(own)), {1: 0.40, 2: 0.55, 3: 0.75}.get(n, 9))
            a, b = number.get(level), number.get(jl)
            lvl = 0.7 if b is None else 0.5 if a is None else {0: 1.0, 1: 0.5}.get(abs(a - b), 0.0)
            top, floor = high or low, floors[u]
            pay = 1.0 if not floor else 0.7 if top is None else 1.0 if top >= floor else 0.5 if top >= floor * 0.9 else 0.0
            q, age = 0.5 if honesty is None else honesty / 100 if honesty > 1 else honesty, (dt.date(2024, 2, 1) - seen).days
            fresh = q * (1.0 if age <= 3 else 0.5 if age >= 30 else 1.0 - 0.5 * (age - 3) / 27)
            total = math.floor((0.50 * f1 + 0.20 * lvl + 0.20 * pay + 0.10 * fresh) * 1e6 + 0.5) / 1e6
            scored.append((-total, -math.floor(f1 * 1e6 + 0.5) / 1e6, job))
        want += [(u, job, -t, -f, place) for place, (t, f, job) in enumerate(sorted(scored)[:7], 1)]
    for block in (50_000, 60):
        got = [(x.resume_id, x.job_id, x.match_score, x.skill_overlap, x.place) for x in M.match_jobs(r, j, rs, js, 7, "2024-02-01", block).collect()]
        assert sorted(got) == sorted(want)


def test_resumes_of_a_kind_are_ranked_once(spark):
    """Many resumes of few profiles, levels and floors: as ranked one by one, and no row a (resume, candidate) is sorted."""
    people, posts, r, rs, j, js = fixture(spark, seed=13, resumes=90, jobs=150, skills=3)
    floors = {p[0]: random.Random(p[0]).choice([None, 0.0, 55.0, 61.0]) for p in people}
    r = r.join(spark.createDataFrame(list(floors.items()), "resume_id string, salary_floor double"), "resume_id")
    j = j.withColumns({"honesty_score": F.lit(80.0), "ingested_at": F.lit("2024-01-20").cast("date")})
    df = M.match_jobs(r, j, rs, js, 5, "2024-02-01")
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan
    number = {"entry": 0, "associate": 1, "mid": 2, "senior": 3}
    want = []
    for u, level, _, own in people:
        scored = []
        for job, _, jl, pay, wants in posts:
            both, n, a, b = len(set(own) & set(wants)), len(wants), number.get(level), number.get(jl)
            f1 = min(2.0 * both / (n + len(own)), {1: 0.40, 2: 0.55, 3: 0.75}.get(n, 9))
            lvl = 0.7 if b is None else 0.5 if a is None else {0: 1.0, 1: 0.5}.get(abs(a - b), 0.0)
            fit = 1.0 if not floors[u] else 0.7 if pay is None else 1.0 if pay >= floors[u] else 0.5 if pay >= floors[u] * 0.9 else 0.0
            total = math.floor((0.50 * f1 + 0.20 * lvl + 0.20 * fit + 0.10 * (0.8 * (1.0 - 0.5 * 9 / 27))) * 1e6 + 0.5) / 1e6
            scored.append((-total, -math.floor(f1 * 1e6 + 0.5) / 1e6, job))
        want += [(u, job, -t, -f, place) for place, (t, f, job) in enumerate(sorted(scored)[:5], 1)]
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == 450


def test_bands_of_parts_hold_the_band(spark):
    """What a task drops before the shuffle is nothing of the band, and most of what is not."""
    rng = random.Random(7)
    rows = [(rng.choice("pq"), rng.randint(-1, 1), f"J{i}", rng.choice([None, 10.0, 20.0, 35.5, float(rng.randint(1, 99))]), rng.choice([0.5, rng.random()]), rng.choice([0.1, 0.2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "profile string, jl int, job_id string, top double, base double, f1 double").repartition(2)
    keys = ["profile", "jl"]
    band, whole = M.skyband(df, keys, 4), set(map(tuple, df.collect()))

    def beaten(x, y):  # by y, see skyband
        return (x[3] is None) == (y[3] is None) and (x[3] is None or y[3] >= x[3]) and (y[4] >= x[4] + 2e-6 or (y[4] == x[4] and (y[5] > x[5] or (y[5] == x[5] and y[2] < x[2]))))

    must = {x for x in whole if sum(beaten(x, y) for y in whole if y[:2] == x[:2]) < 4}
    kept = set(map(tuple, band.select(df.columns).collect()))
    assert must <= kept
    for room in (400, 500_000):
        parts = M.skyband_of_parts(df, keys, 4, room=room)
        assert kept == set(map(tuple, M.skyband(parts, keys, 4).select(df.columns).collect()))
        assert kept <= set(map(tuple, parts.collect())) and parts.count() < 1500


def test_neighbours_by_skill_vectors(spark):
    people, posts, r, rs, j, js = fixture(spark, seed=2)
    eligible = j.filter("domain = 'red'")
    got = sorted((x.resume_id, x.job_id, round(x.similarity, 9)) for x in M.skill_neighbours(r, j, rs, js, eligible, nearest=60, keep=7).collect())
    want = []
    for u, _, _, own in people:
        near = sorted((-len(set(own) & set(w)) / math.sqrt(float(len(own) * len(w))), job, m) for job, m, _, _, w in posts if set(own) & set(w))[:60]
        want += [(u, job, round(-s, 9)) for s, job, m in near if m == "red"][:7]
    assert got == sorted(want)


def test_neighbours_are_scored_once_a_profile(spark):
    """Many resumes and postings of few skill sets, ties at the cut: as all pairs scored one by one."""
    people, posts, r, rs, j, js = fixture(spark, seed=5, resumes=60, jobs=240, skills=5)
    floors = {p[0]: random.Random(p[0]).choice([None, 52.0, 70.0, 90.0]) for p in people}
    r = r.join(spark.createDataFrame(list(floors.items()), "resume_id string, salary_floor double"), "resume_id")
    number, want = {"entry": 0, "associate": 1, "mid": 2, "senior": 3}, []
    for u, level, _, own in people:
        near = sorted((-len(set(own) & set(w)) / math.sqrt(float(len(own) * len(w))), x, p) for p, (x, *_, w) in enumerate(posts) if set(own) & set(w))[:25]
        scored = []
        for s, job, p in [x for x in near if posts[x[2]][1] == "red"][:9]:
            _, _, jl, pay, w = posts[p]
            both, n, a, b = len(set(own) & set(w)), len(w), number.get(level), number.get(jl)
            f1 = min(2.0 * both / (n + len(own)), {1: 0.40, 2: 0.55, 3: 0.75}.get(n, 9))
            lvl = 0.7 if b is None else 0.5 if a is None else {0: 1.0, 1: 0.5}.get(abs(a - b), 0.0)
            fit = 1.0 if not floors[u] else 0.7 if pay is None else 1.0 if pay >= floors[u] else 0.5 if pay >= floors[u] * 0.9 else 0.0
            scored.append((-round(-s * 0.60 + f1 * 0.15 + lvl * 0.15 + fit * 0.10, 6), job, round(f1, 4)))
        want += [(u, job, -s, f1, place) for place, (s, job, f1) in enumerate(sorted(scored)[:4], 1)]
    got = M.match_neighbours(r, j, j, rs, js.union(js), j.filter("domain = 'red'"), 4, nearest=25, keep=9)
    assert sorted((x.resume_id, x.job_id, x.match_score, x.skill_overlap, x.place) for x in got.collect()) == sorted(want) and len(want) > 60
    pairs = M.skill_neighbours(r, j, rs, js, j.filter("domain = 'red'"), nearest=25, keep=9)
    again = M.match_candidates(pairs, r, j, rs, js, 4)
    assert sorted((x.resume_id, x.job_id, x.match_score, x.skill_overlap, x.place) for x in again.collect()) == sorted(want)


def test_estimates_are_made_once_a_profile(spark):
    """Many resumes of few profiles: the same estimates as resume by resume, from one row a (profile, posting)."""
    people, posts, r, rs, j, js = fixture(spark, seed=3, resumes=80, jobs=120, skills=3)
    worth = spark.createDataFrame([(m, f"S{i}", 1 / (i + 2)) for m in ("red", "blue") for i in range(3)], "domain string, skill_id string, weight double")
    honesty = spark.createDataFrame([(p[0], float(i % 90)) for i, p in enumerate(posts) if i % 4], "job_id string, honesty_score double")
    fits = r.select("resume_id", F.lit("c").alias("cohort"), F.length("resume_id").cast("double").alias("market_fit"))
    members, matches = M.profile_job_matches(r, j, rs, js, worth, 9)
    pay = j.withColumn("salary_min_annual", F.col("salary_max_annual") - F.lit(10))
    got = sorted(map(tuple, M.resume_estimates(matches, pay, honesty, fits, members).collect()), key=str)
    want = sorted(map(tuple, M.resume_estimates(M.weighted_job_matches(r, j, rs, js, worth, 9), pay, honesty, fits).collect()), key=str)
    assert got == want and len(got) == 80 and matches.count() < 9 * 40


def test_codes_find_neighbours_for_few_scores(spark):
    rng = np.random.default_rng(3)
    items, queries = rng.normal(size=(2000, 32)), rng.normal(size=(12, 32))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(-1, None)], "item_id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    # Several blocks of queries and slices of items give what one of each does.
    near = V.ann_candidates(q, c, block=5, slice_rows=700)
    same = V.ann_candidates(q, c)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, same.collect()))
    scored = near.groupBy("query_id").count().collect()
    assert len(scored) == 12 and max(x["count"] for x in scored) <= 200
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = np.argsort(-(unit(queries) @ unit(items).T), axis=1)[:, :10]
    found = {}
    for x in V.ann(q, c, 10).collect():
        found.setdefault(x.query_id, set()).add(x.item_id)
    assert np.mean([len(found[i] & set(exact[i].tolist())) / 10 for i in range(12)]) >= 0.9
    assert V.ann(q, c.filter("item_id > 5000"), 10).count() == 0


def test_encoder_is_pluggable_and_skips_done(spark):
    rows = [(f"J{i}", "C1", "Clerk", "We sell hats and shoes to everyone in this town and all the towns around it, every day. " * 2 + f"own words {i} " * 20 + f"number{i}") for i in range(5)] + [("J9", "C2", None, None)]
    posts = spark.createDataFrame(rows, "job_id string, company_id string, role_name string, description_text string")

    def lengths():
        return lambda texts: np.array([[len(t or ""), 1.0] for t in texts], np.float32)

    done = spark.createDataFrame([("J0",)], "job_id string")
    out = {r.job_id: r for r in V.embed_postings(posts, done, lengths, unit=False).collect()}
    assert sorted(out) == ["J1", "J2", "J3", "J4", "J9"]
    assert all(out[k].vector == [len(out[k].model_text), 1.0] for k in out)
    assert "hats" not in out["J1"].model_text and "number1" in out["J1"].model_text and out["J9"].model_text == ". "
    unit = V.embed_postings(posts, done).collect()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 or not any(r.vector) for r in unit)


def test_level_rules(spark):
    labels = ["junior", "lead", "senior"]
    cases = [("Junior Clerk", [0.1, 0.1, 0.8], "junior", "title"), ("Senior Clerk", [0.9, 0.05, 0.05], "senior", "title_override"), ("Head Clerk", [0.5, 0.2, 0.3], "lead", "title_override"), ("Clerk", [0.55, 0.25, 0.2], "mid", "mid_zone"),
             ("Clerk", [0.2, 0.2, 0.6], "mid", "mid_zone"), ("Clerk", [0.2, 0.19, 0.61], "senior", "model"), ("Clerk", [0.3, 0.45, 0.25], "mid", "unsure"), ("Clerk", [0.2, 0.6, 0.2], "lead", "model"), (None, [0.34, 0.33, 0.33], "mid", "unsure"),
             ("Senior Clerk", [0.3, 0.3, 0.4], "senior", "model"), ("Lead Clerk", [0.2, 0.3, 0.5], "senior", "model")]
    df = spark.createDataFrame([(t, p) for t, p, _, _ in cases], "t string, p array<double>")
    got = [(r.d.level, r.d.rule) for r in df.select(V.decide_level(F.col("t"), F.col("p"), labels).alias("d")).collect()]
    assert got == [(a, b) for _, _, a, b in cases]
    table = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("b", "a")], "x string, y string")
    assert sorted(map(tuple, V.confusion(table, "x", "y", ["a", "b"]).collect())) == [("a", 1, 2), ("b", 1, 0)]


def test_title_labels_train_a_model(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"{('Junior', 'Lead', 'Senior')[i % 3]} Clerk" if i % 4 else "Clerk", (rng.normal(size=6) * 0.3 + np.eye(6)[i % 3] * 3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, title string, v array<double>")
    labels = ["junior", "lead", "senior"]
    model, report = V.train_title_levels(df, "v", "title", labels)
    assert min(r.f1 for r in report.collect()) > 0.9
    out = V.predict_level(model, df.filter("title = 'Clerk'"), "id", "v", "title", labels).collect()
    assert np.mean([r.level == labels[r.id % 3] for r in out]) > 0.9
