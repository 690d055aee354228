"""Folds by key: many keys in a task, keys that span batches, null keys."""

from panelspark.operators.folds import folded


def test_keys_in_order_whatever_the_batches(spark):
    rows = [(k if k else None, i, f"t{i}") for k in range(50) for i in range(k % 7 + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame(rows[::-1], "doc long, n long, text string")
        got = folded(df, ["doc"], ["n"], lambda held: [(held[0].doc, len(held), "".join(x.text for x in held))], "doc long, n long, text string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == {(k if k else None, k % 7 + 1, "".join(f"t{i}" for i in range(k % 7 + 1))) for k in range(50)}
    assert len(got) == 50


def test_a_fold_needs_no_call_a_document(spark):
    """Documents reach Python in batches of many, not one by one (grouped calls took milliseconds a document)."""
    from panelspark.operators import layout

    rows = spark.createDataFrame([(d, r, r, 5.0, f"Page {r}") for d in range(20) for r in (1, 2)], "doc_id long, row_no long, page long, y double, text string")
    plan = layout.greedy_repeats(rows, 30)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    assert layout.greedy_repeats(rows, 30).count() == 40


def test_codes_near_against_all_pairs_on_a_crowded_page(spark):
    """Ties in x, spots with several lines, heights in fractions; and no pair of all targets with all codes."""
    import random

    from panelspark.operators import panels

    r = random.Random(5)
    rows = [(d, 1 + n % 2, n, r.randrange(12), r.randrange(40) / 4, r.choice([f"LOINC: {r.randrange(900)}-5", f"CPT #80{n % 7}", f"LOINC: {n}-1 CPT #81{n % 9}", "plain"])) for d in range(3) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, page long, line_no long, x long, y double, text string")
    got = panels.codes_near(df.where("line_no % 3 = 0"), df, 2)
    df.createOrReplaceTempView("crowded")
    t, c = df.where("line_no % 3 = 0").collect(), df.collect()
    import re

    want = {}
    for a in t:
        near = sorted((abs(b.x - a.x), b.line_no, b.text) for b in c if (b.doc_id, b.page) == (a.doc_id, a.page) and abs(b.y - a.y) <= 2 and b.text != "plain")
        first = lambda form: next((m.group(1) for _, _, text in near if (m := re.search(form, text))), None)
        if near:
            want[a.doc_id, a.line_no] = (first(r"LOINC: (\d+-\d)"), first(r"CPT #(\d+)"))
    found = {(x.doc_id, x.line_no): (x.loinc, x.cpt) for x in got.collect()}
    assert found.keys() == want.keys()
    assert found == want


def test_items_lie_in_partitions_by_their_number(spark, tmp_path, monkeypatch):
    """More items make more partitions, not larger ones, and a document is in one of them."""
    from pyspark.sql import functions as F

    from panelspark.sources import lines

    monkeypatch.setattr(lines, "ITEMS_A_PARTITION", 10)
    monkeypatch.setattr(lines, "LEAST_ITEMS", 5)
    for n in (40, 400):
        spark.range(n).select((F.col("id") % (n // 4)).alias("l_orderkey"), "id").write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        items = lines._items(spark, f"{tmp_path}/{n}")
        assert items.rdd.getNumPartitions() == max(n // 10, 8)
        assert items.select("doc_id", F.spark_partition_id().alias("k")).distinct().count() == n // 4


def test_repeated_pairs_against_all_pairs_and_without_joins(spark):
    import random

    from panelspark.operators import layout

    r = random.Random(3)
    rows = [(d, n, 1 + n // 3, r.choice([5.0, 60.0, 99.5, 905.0, 950.25, 999.0, 500.0]), " ".join(r.choices("Page of report lab a b c".split(), k=r.randrange(6)))) for d in (1, 2, None) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, row_no long, page long, y double, text string")
    got = layout.repeated_pairs(df, 60)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    edges = [(d, n, p, y, set(t.lower().split())) for d, n, p, y, t in rows if d and (y < 100 or y > 900) and t]
    want = {(a[0], a[1], b[1], len(a[4] & b[4]), len(a[4] | b[4])) for a in edges for b in edges if a[0] == b[0] and a[2] < b[2] and abs(a[3] - b[3]) < 100 and 100 * len(a[4] & b[4]) >= 60 * len(a[4] | b[4])}
    found = [tuple(x) for x in got.where("doc_id is not null").collect()]
    assert set(found) == want and len(found) == len(want) > 30


def test_rows_are_merged_as_a_plain_loop_does_without_grouping(spark, tmp_path):
    """Cells of a document are sorted for windows; grouping them, as before, sorted and packed each list twice."""
    import random

    from pyspark.sql import functions as F

    from panelspark.operators import layout
    from panelspark.plans import documents, report

    r = random.Random(8)
    cells = [(d, n, 1 + n // 20, r.randrange(0, 120), r.randrange(5) * 50, r.choice(["a", " 7 ", "", None, "long enough text", "Bold"]), r.random() < 0.4, r.choice([8, 10, 12, None])) for d in (1, 2, None) for n in range(60)]
    df = spark.createDataFrame(cells, "doc_id long, line_no long, page int, y int, x int, text string, is_bold boolean, font int")
    bins: dict = {}
    for d, p in sorted({(str(c[0]), c[2]) for c in cells}):
        at, last = 0, None
        for c in sorted((c for c in cells if (str(c[0]), c[2]) == (d, p)), key=lambda c: (c[3], c[1])):
            at += last is None or c[3] - last > 6
            last = c[3]
            bins.setdefault((d, p, at), []).append(c)
    want, numbers = {}, {}
    for (d, p, b), held in sorted(bins.items()):
        held.sort(key=lambda c: (c[4], c[1]))
        text = "\t".join(c[5].strip() for c in held if c[5] is not None)
        fonts = sorted(c[7] for c in held if c[7] is not None)
        bold, font = any(c[6] for c in held), (fonts[(len(fonts) - 1) // 2] + fonts[len(fonts) // 2]) / 2 if fonts else None
        if len(held) >= 2 or any(ch.isdigit() for ch in text) or (bold and (font or 0) >= 11) or len(text) >= 10:
            numbers[d] = numbers.get(d, 0) + 1
            want[d, numbers[d]] = (p, b, text, sum(c[3] for c in held) / len(held), bold, font, held[0][4], held[-1][4], len(held), min(c[1] for c in held))
    got = layout.merge_rows(df, 6)
    found = {(str(x.doc_id), x.row_no): (x.page, x.bin, x.text, x.y, x.is_bold, x.font, x.x_left, x.x_right, x.n_cells, x.first_line) for x in got.collect()}
    assert found == want and len(want) < len(bins)

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
    spark.range(300).select((F.col("id") % 70).alias("l_orderkey"), *(F.col("id").alias(c) for c in order), F.lit("R").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, query in [*((n, report.QUERIES[n]) for n in ("quarantine_basic", "repeat_header_exact", "split_row_lead", "document_scores")), *((n, documents.QUERIES[n]) for n in ("expected_panels", "role_documents"))]:
        assert query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1, name
    plan = report.quarantine_basic(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "lambda" not in plan


def test_work_on_rows_stays_in_the_partitions_of_items(spark, tmp_path, monkeypatch):
    """F19 to F32: one shuffle of the items, in more partitions when there are more items; only sums over the whole table are sent after it."""
    import re

    from pyspark.sql import functions as F

    from panelspark.plans import documents, report
    from panelspark.sources import lines

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
    spark.range(300).select((F.col("id") % 70).alias("l_orderkey"), *(F.col("id").alias(c) for c in order), F.lit("R").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(lines, "ITEMS_A_PARTITION", 20, raising=False)
    sums = ("review_reasons", "rollup_quality")
    of_rows = "split_row_lead unknown_clusters row_confidence field_scores quarantine_basic heuristic_gate coarse_fields parse_row_rules document_scores row_heuristic break_similarity".split()
    for name in ("role_documents", *sums, *of_rows):
        plan = (report.QUERIES | documents.QUERIES)[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        sent = [x.strip() for x in plan.splitlines() if re.search(r"\bExchange ", x)]
        assert re.search(r"hashpartitioning\(doc_id#\w+, 15\), REPARTITION_BY_NUM", sent[-1]), (name, sent)
        assert "Join" not in plan and (name in sums or len(sent) == 1), (name, sent)
        assert all("REPARTITION" not in x for x in sent[:-1]), (name, sent)
