import time

from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import paths as P
from shelfmark.operators.context_names import _terms_in_row, _terms_of_shared, contextual_names, ranked_terms
from shelfmark.operators.standardize import standardize_names


def apply(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r["v"]: r["o"] for r in df.select("v", expr(F.col("v")).alias("o")).collect()}


def test_dates(spark):
    """Every form once, forms that win over others, and matches that are no dates."""
    cases = {
        "minutes 2017_11_30 signed": "2017-11-30", "%20Gas%202018-02-28": "2018-02-28", "payslip.07.08.2016": "2016-08-07",
        "log 45_12_2020": None, "budget 2024-09": "2024-09", "session 2015-16 papers": "2015-16", "session 2015-17 papers": "2015",
        "photo 24122011": "2011-12-24", "meter 310519": "2019-05-31", "meter 320519": None, "Trip to Oslo dec_2013": "2013-12",
        "feb-apr 2014 rota": "2014", "rent october to november 2012": "2012", "archive 2010": "2010", "ledger 1987-04": "1987-04",
        "2016-05-04 and 03-02-2001": "2016-05-04", "no date at all": None, "": None, "2021-00-10": "2021", "x20190101y": None,
    }
    assert apply(spark, N.extract_date, cases) == cases


def test_versions(spark):
    cases = {"plan rev 3": "Rev3", "Revision_12 x": "Rev12", "draft v2": "V2", "version 7": "V7", "part-4": "Part4",
             "module 5": "Module5", "mod6": "Module6", "lecture 9": "Lec9", "report (2)": "2", "report (2) x": None, "nothing": None}
    assert apply(spark, N.extract_version, cases) == cases


def test_benign_suffixes(spark):
    cases = {"Report final": "Report", "Report (2)": "Report", "Report copy (3)": "Report", "_Report_": "Report", "a copy_": "a",
             "photocopy": "photocopy", "Report_final": "Report_final", "copy_final": "copy_final", "Scan scanned": "", "x - Copy": "x"}
    assert apply(spark, N.strip_benign, cases) == cases


def test_words_and_chunks(spark):
    assert apply(spark, N.split_words, ["A%20b&c(d).e_f"])["A%20b&c(d).e_f"] == ["A", "b", "and", "c", "d", "e", "f"]
    chunk = lambda v: N.canonical_chunks(N.split_words(v))
    cases = {"Form 16 x": ["FORM16", "x"], "module 3 notes": ["Module3", "notes"], "q4 result": ["Q4", "result"],
             "bank statement 2": ["bank_statement", "2"], "a Vs b": ["a", "vs", "b"], "Lecture 7": ["Lecture7"], "q4": ["q4"],
             "annual report floor plan": ["annual_report", "floor_plan"]}
    assert apply(spark, chunk, cases) == cases
    cases = {"vs": "vs", "bank_statement": "BankStatement", "FORM16": "FORM16", "hello": "Hello", "iPhone": "IPhone", "2023": "2023"}
    assert apply(spark, N.format_chunk, cases) == cases


def test_types(spark):
    df = spark.createDataFrame([("my bank statement", ".pdf", "BankStatement"), ("site visit", ".jpg", "Photo"), ("x", ".png", "MediaFile"),
                                ("x", ".csv", "Data"), ("x", ".docx", "Document"), ("x", ".zip", None), ("pan card", ".jpg", "PANCard"),
                                ("electricity bill", ".pdf", "ElectricityBill"), ("some bill", ".pdf", "Bill")], "t string, e string, w string")
    for r in df.withColumn("g", N.infer_type("t", F.col("e"))).collect():
        assert r["g"] == r["w"], r


def test_vague(spark, inventory):
    cases = {"12345.pdf": True, "IMG_123.png": True, "img_1.jpg": True, "0012_a.jpg": False, "scan 4.pdf": True, "copy.txt": True,
             "Report.txt": False, "new document 3.docx": True, "temp file copy notes.txt": True, "tax return copy.pdf": True,
             "deadbeef01.pdf": True, "tax return 2021 april copy.pdf": False}
    df = P.with_parts(inventory(list(cases))).withColumn("v", N.is_vague(F.trim("stem"), F.col("ext")))
    assert {r["path"]: r["v"] for r in df.collect()} == cases


def standard(spark, names, **hints):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {r["name"]: r for r in standardize_names(df, "name", **hints).collect()}


def test_standard_names(spark):
    cases = {
        "ITR-V Verification Form PDF 2021-22.pdf": None,
        "Form 16 2021-22.pdf": "FORM16_2021_22",
        "Acme_Bank Statement_and_Salary Slip_15-01-2023.png": None,
        "Bank Statement 2023-01-15.pdf": "BankStatement_2023-01-15",
        "Invoice Amazon 31-12-2022.pdf": "Invoice_2022-12-31",
    }
    got = standard(spark, cases)
    assert {n: got[n]["proposed_base"] for n in cases} == cases
    row = got["Bank Statement 2023-01-15.pdf"]
    assert (row["doc_type"], row["doc_date"], row["pattern_class"], row["skip_reason"]) == ("BankStatement", "2023-01-15", "financial_tax", None)


def test_person_names_survive(spark):
    cases = {
        "Testperson-Electricity Bill_15-01-2023.Draft.pdf": "TestPersonSurname_ElectricityBill_2023-01-15_Draft",
        "Testperson_Water Bill_final.pdf.bak": "TestPersonSurname_WaterBill_Final",
        "Testperson Aadhaar Card.pdf": "TestPersonSurname_AadhaarCard_UIDAI",
        "Testperson_Notes_Project_Phase_Final_Approved_By_Manager_Jan 2023.pdf": None,
        "%20Testperson%20Bank Statement%202023-01-15.pdf": "TestPersonSurname_BankStatement_2023-01-15",
    }
    got = standard(spark, cases, person={"testperson": "TestPersonSurname"})
    assert {n: got[n]["proposed_base"] for n in cases} == cases


def test_skip_reasons(spark):
    cases = {
        "settings one.ini": "config_file", "12345.pdf": "weak_name", "Tax_Report.pdf": "already_standard",
        "Bank_Statement_2021 (1).pdf": "already_standard", "notes copy.txt": "suffix_only", "my report.pdf": "short_title",
        "one two three four five six.mp3": "media_title", "alpha-beta-gamma.zip": "readable", "alphabeta.zip": "no_noise",
    }
    got = standard(spark, cases)
    assert {n: got[n]["skip_reason"] for n in cases} == cases


def test_light_clean_up_and_roles(spark):
    # worked out by hand from the rules
    cases = {
        "Module 3 soil mechanics notes.pdf": "Module3_Soil_Mechanics_Notes",     # light: number joined, type word kept
        "Level 2 Floor Plan (1).dwg": "Level2_FloorPlan",                        # light: suffix dropped, phrase joined
        "GATE admit card form.pdf": "Admit_Form_AdmitCard_GATE",                 # roles: topic, type, issuer
        "steel design vs code book 7.pdf": "SteelDesign_vs_Code_BOOK7",  # a word of up to four letters takes its number before phrases are joined
    }
    cases.update({
        "Lecture 5 fluid mechanics (1).pdf": None,                               # only a benign suffix on a title
        "Site Layout Springfield rev 2.dwg": "Site_Layout_Springfield_REV2",     # light: technical extension, number joined
        # too many parts for a light clean-up; roles of the study class: five topic chunks, type, version
        "Complete structural analysis and design notes volume part 3 of revised set.pdf":
            "Complete_Structural_Analysis_Design_Volume_Notes_Part3",
        "Artist - Song title (2).mp3": None,                                     # a media title with a benign suffix
    })
    got = standard(spark, cases)
    assert {n: got[n]["proposed_base"] for n in cases} == cases


def named(spark, rows, schema, **options):
    df = P.with_parts(spark.createDataFrame(rows, schema))
    return {r["path"]: r["context_name"] for r in contextual_names(df, **options).collect()}


def test_contextual_names(spark):
    rows = [("Finance/Tax Returns/scan_1.pdf",), ("Trips/Goa Beach/0012_a.jpg",), ("a/b/to.by",), ("Zed/to.by",)]
    got = named(spark, rows, "path string")
    # context weight 2, extension weight 1; stopwords and short words out; ties by first appearance
    assert got["Finance/Tax Returns/scan_1.pdf"] == "Tax_Returns_Finance"
    assert got["Trips/Goa Beach/0012_a.jpg"] == "0012_a_0012_Goa_Beach_Trips"
    assert got["Zed/to.by"] == "Zed" and got["a/b/to.by"] == "B"


def test_contextual_names_with_content_topic_and_label(spark):
    rows = [("Misc/scan_1.txt", "invoice from acme acme total invoice acme", "Bills_Tax", 0.5, None),
            ("Misc/scan_2.txt", "nothing", "Bills_Tax", 0.1, "Goa trip"), ("Misc/0007.jpg", "", None, None, "Goa trip"),
            ("Misc/beach house plan.txt", "", None, None, "Goa trip")]
    got = named(spark, rows, "path string, content string, topic string, score double, label string", content="content", topic="topic",
                score="score", label="label")
    assert got["Misc/scan_1.txt"] == "Bills_Tax_Acme_Invoice_Total"
    assert got["Misc/scan_2.txt"] == "Goa_Trip_Nothing_Misc"
    assert got["Misc/0007.jpg"] == "Goa_Trip_0007"
    assert got["Misc/beach house plan.txt"] == "Goa_Trip_Beach_House_Plan"
    suffix = named(spark, [("Misc/0007.jpg", "Goa trip")], "path string, label string", label="label", serial_as_suffix=True)
    assert suffix["Misc/0007.jpg"] == "Goa_Trip_0007"


def test_results_can_be_filtered_by_any_column(spark):
    """A filter must not be written into every stage: planning used to take minutes."""
    names = [f"Invoice {k} final (2) 0{k % 9 + 1}-02-2023.pdf" for k in range(20)] + ["report.txt", "", "v2.doc"]
    rows = standardize_names(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    whole = rows.collect()
    for column in ("proposed_base", "doc_type", "doc_date", "version", "skip_reason"):
        started = time.perf_counter()
        kept = rows.filter(F.col(column).isNotNull())
        kept._jdf.queryExecution().executedPlan()
        assert time.perf_counter() - started < 20, column
        assert kept.count() == sum(r[column] is not None for r in whole)


def test_texts_are_not_shuffled_for_content_names(spark):
    files = P.with_parts(spark.createDataFrame([("a/b c.txt", "tax return tax"), ("d.txt", None)], "path string, text string"))
    plan = contextual_names(files, content="text").select("path", "context_name")._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.splitlines() if "Exchange" in line]
    assert below and not any("text" in line for line in below)


def test_names_of_one_task_are_dealt_over_the_cluster(spark):
    from shelfmark.operators.standardize import standardize_names

    names = spark.range(200).coalesce(1).selectExpr("id", "concat('lecture ', id, ' flight dynamics notes.pdf') AS name")
    made = standardize_names(names)
    assert made.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and made.count() == 200


def test_words_of_single_files_are_not_shuffled_and_shared_paths_count_together(spark):
    rows = [("a/b c.txt", "tax return tax Return RETURN"), ("x/same.txt", "alpha beta beta"), ("x/same.txt", "alpha gamma alpha"), ("d.txt", None)]
    files = P.with_parts(spark.createDataFrame(rows, "path string, text string"))
    many = files.unionByName(P.with_parts(spark.range(50).selectExpr("concat('m/', id) AS path", "concat_ws(' ', transform(sequence(0, 500), i -> concat('word', i * id))) AS text")))
    got = {r["path"]: r["terms"] for r in ranked_terms(many, "text").collect()}
    assert got["a/b c.txt"][:2] == ["return", "tax"] and got["x/same.txt"][:2] == ["alpha", "beta"] and got["m/3"] == ["word0", "word3", "word6", "word9", "word12"]
    for path, terms in _terms_of_shared(files, "text", 5).collect():  # the words' way, for every file
        assert got[path] == terms
    assert not any("Generate" in line for line in _terms_in_row(files, "text", 5)._jdf.queryExecution().executedPlan().toString().splitlines())
