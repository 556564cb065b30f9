"""The five sources and their detail documents, from files and from rows."""

import datetime
import json
import uuid
from collections import Counter

import pytest
from landed import ACME, BOARD, FEED, RSS, SEARCH, detail, flat_feed, listing, page, posting, rss
from pyspark.sql import functions as F

from postledger.config import Company, companies_frame
from postledger.functions import strip_html
from postledger.sources import (
    Source,
    completeness,
    items_from_bodies,
    limit_listing,
    normalise,
    read_details,
    read_items,
    register,
    registered,
    source,
)
from workloads import landed as workload


def read(spark, root, *companies):
    entry = source(companies[0].ats)
    rows = normalise(read_items(spark, str(root), entry), entry, companies_frame(spark, companies))
    return rows.cache()


def usable(rows):
    return rows.where("usable").orderBy("company", "ordinal").collect()


def complete(rows):
    return {r.company: r.complete for r in completeness(rows).collect()}


def test_paged_listing_maps_fields(spark, tmp_path):
    listing(tmp_path, ACME, page([posting(1, "ML Engineer", "Germany, Jena")]))
    (row,) = usable(read(spark, tmp_path, ACME))
    assert row.unique_key == "Acme::R1"
    assert row.url == "https://jobs.example.org/Careers/job/Germany-Jena/ML-Engineer_R1"
    assert (row.title, row.location, row.department, row.raw_description) == (
        "ML Engineer", "Germany, Jena", "", "",
    )
    assert row.posted_date is None


def test_pages_are_concatenated_in_order(spark, tmp_path):
    first = [posting(i) for i in range(20)]
    listing(tmp_path, ACME, page(first, 25), 0)
    listing(tmp_path, ACME, page([posting(i) for i in range(20, 25)], 25), 20)
    rows = read(spark, tmp_path, ACME)
    assert [r.ats_job_id for r in usable(rows)] == [f"R{i}" for i in range(25)]
    assert complete(rows) == {"Acme": True}


def test_missing_page_makes_a_listing_incomplete(spark, tmp_path):
    listing(tmp_path, ACME, page([posting(i) for i in range(20)], 25))
    rows = read(spark, tmp_path, ACME)
    assert len(usable(rows)) == 20
    assert complete(rows) == {"Acme": False}


def test_announced_total_cuts_nothing(spark, tmp_path):
    listing(tmp_path, ACME, page([posting(i) for i in range(3)], 2))
    rows = read(spark, tmp_path, ACME)
    assert len(usable(rows)) == 3
    assert complete(rows) == {"Acme": True}


def test_empty_listing_counts_as_scanned(spark, tmp_path):
    listing(tmp_path, ACME, page([]))
    rows = read(spark, tmp_path, ACME)
    assert usable(rows) == []
    assert complete(rows) == {"Acme": True}


def test_unreadable_page_makes_a_listing_incomplete(spark, tmp_path):
    listing(tmp_path, ACME, page([posting(1)]), 0)
    listing(tmp_path, ACME, '{"total": 1, "jobPost', 20)
    rows = read(spark, tmp_path, ACME)
    assert [r.ats_job_id for r in usable(rows)] == ["R1"]
    assert complete(rows) == {"Acme": False}


def test_id_falls_back_to_path_for_an_empty_array_only(spark, tmp_path):
    entries = [
        posting(1, bullets=[], path="/job/x"),
        posting(2, bullets=[""], path="/job/y"),
        {"title": "no bullets", "externalPath": "/job/z"},
    ]
    listing(tmp_path, ACME, page(entries))
    assert [r.ats_job_id for r in usable(read(spark, tmp_path, ACME))] == ["/job/x", "", "/job/z"]


def test_limit(spark, tmp_path):
    listing(tmp_path, ACME, page([posting(i) for i in range(20)], 60), 0)
    listing(tmp_path, ACME, page([posting(i) for i in range(20, 40)], 60), 20)
    items = read_items(spark, str(tmp_path), source("workday"))
    for limit, expected in ((5, 5), (25, 25), (None, 40), (100, 40)):
        kept = limit_listing(items, limit).orderBy("ordinal").collect()
        assert [r.item.bulletFields[0] for r in kept] == [f"R{i}" for i in range(expected)]


def test_many_companies_share_one_scan(spark, tmp_path):
    other = type(ACME)("42", "workday", {**ACME.config, "base_url": "https://other.example.org"})
    listing(tmp_path, ACME, page([posting(1)]))
    listing(tmp_path, other, page([posting(1)]))
    rows = usable(read(spark, tmp_path, ACME, other))
    assert {r.unique_key for r in rows} == {"Acme::R1", "42::R1"}
    assert {r.url.split("/Careers")[0] for r in rows} == {
        "https://jobs.example.org", "https://other.example.org",
    }


def test_paged_detail(spark, tmp_path):
    path = posting(1, "C++ Dev", "Germany, Bad Ems")["externalPath"]
    info = {"jobDescription": "<p>Hi</p>", "jobCategory": {"descriptor": "Research"}}
    detail(tmp_path, ACME, path, {"jobPostingInfo": info})
    detail(tmp_path, ACME, "/job/broken", '{"jobPostingInfo": ')
    detail(tmp_path, ACME, "/bare", {})
    rows = {r.detail_ref: r for r in read_details(spark, str(tmp_path), source("workday")).collect()}
    listing(tmp_path, ACME, page([posting(1, "C++ Dev", "Germany, Bad Ems")]))
    (row,) = usable(read(spark, tmp_path, ACME))
    assert len(rows) == 2
    found = rows[row.detail_ref]
    assert (found.detail_description, found.detail_department) == ("<p>Hi</p>", "Research")


def test_board(spark, tmp_path):
    jobs = [
        {"id": 4711, "title": "Driver", "absolute_url": "https://b.example/1",
         "location": {"name": "Ulm"}, "departments": [{"id": 1, "name": "Road"}, {"id": 2, "name": "Sea"}]},
        {"id": 2, "title": "None", "absolute_url": "u", "location": None, "departments": []},
        {"title": "no id", "departments": None},
    ]
    listing(tmp_path, BOARD, {"jobs": jobs})
    rows = usable(read(spark, tmp_path, BOARD))
    assert [(r.unique_key, r.location, r.department) for r in rows] == [
        ("Bolt::4711", "Ulm", "Road"), ("Bolt::2", "", ""), ("Bolt::", "", ""),
    ]
    assert rows[2].detail_ref is None
    detail(tmp_path, BOARD, "4711", {"id": 4711, "content": "<b>x</b>"})
    (found,) = read_details(spark, str(tmp_path), source("greenhouse")).collect()
    assert found.detail_ref == rows[0].detail_ref
    assert (found.detail_description, found.detail_department) == ("<b>x</b>", None)


def test_empty_board(spark, tmp_path):
    listing(tmp_path, BOARD, {"jobs": []})
    rows = read(spark, tmp_path, BOARD)
    assert usable(rows) == [] and complete(rows) == {"Bolt": True}


def search_page(entries, total):
    items = [{"MatchedObjectDescriptor": e} if e is not None else {"Other": 1} for e in entries]
    return {"SearchResult": {"SearchResultCountAll": total, "SearchResultItems": items}}


def test_search_result(spark, tmp_path):
    def entry(number, **more):
        return {"ID": f"M{number}", "PositionTitle": f"T{number}", "PositionURI": f"u{number}", **more}

    text = [{"Tasks": "", "Content": "<i>content</i>"}]
    entries = [
        entry(1, PublicationStartDate="2026-03-01T00:00:00Z", JobCategory=[{"Name": "Law"}],
              PositionLocation=[{"CityName": "Ulm", "CountryCode": "DE"}],
              PositionFormattedDescription=[{"Tasks": "tasks", "Content": "no"}]),
        entry(2, PublicationStartDate="2026-3-1", PositionLocation=[{"CityName": "Ulm"}],
              PositionFormattedDescription=text),
        None,
        entry(3, PublicationStartDate="", PositionLocation=[{"CityName": "", "CountryCode": "DE"}]),
        entry(4, PositionLocation=None, JobCategory=None, PositionFormattedDescription=None),
    ]
    listing(tmp_path, SEARCH, search_page(entries, 6), 0)
    listing(tmp_path, SEARCH, search_page([entry(5)], 6), 100)
    rows = read(spark, tmp_path, SEARCH)
    out = usable(rows)
    assert [r.ats_job_id for r in out] == ["M1", "M2", "M3", "M4", "M5"]
    assert [r.location for r in out] == ["Ulm, DE", "Ulm", "DE", "", ""]
    assert [r.raw_description for r in out] == ["tasks", "<i>content</i>", "", "", ""]
    assert [r.department for r in out] == ["Law", "", "", "", ""]
    assert [r.posted_date for r in out] == [datetime.date(2026, 3, 1), None, None, None, None]
    assert complete(rows) == {"Carro": True}


def test_flat_feed(spark, tmp_path):
    jobs = [
        {"jobid": "1", "title": " Spaced ", "url": "u", "published": "2026-03-01T05:00:00Z",
         "employer": "Delta X", "description": "<p>a &amp; b</p>",
         "locations": [{"city": "Ulm", "country": "Germany"}, {"city": "Bonn", "country": "Germany"}]},
        {"jobid": "2", "title": "t", "published": "soon", "locations": []},
        {"title": "no id", "locations": [{"country": "Peru"}]},
    ]
    listing(tmp_path, FEED, flat_feed(*jobs))
    rows = read(spark, tmp_path, FEED)
    out = usable(rows)
    assert [r.unique_key for r in out] == ["Delta::1", "Delta::2", "Delta::"]
    assert [r.location for r in out] == ["Ulm, Germany", "", "Peru"]
    assert [r.title for r in out] == [" Spaced ", "t", "no id"]
    assert [r.posted_date for r in out] == [datetime.date(2026, 3, 1), None, None]
    assert out[0].department == "Delta X"
    assert rows.where("usable").orderBy("ordinal").select(strip_html(F.col("raw_description"))).first()[0] == "a & b"
    assert complete(rows) == {"Delta": True}


def test_rss(spark, tmp_path):
    items = [
        {"title": "A", "link": "l1", "guid": "G1", "g:id": "X1", "g:location": "Wolfsburg, DE",
         "g:job_function": "IT", "description": "&lt;p&gt;Work &amp;amp; play&lt;/p&gt;"},
        {"title": "B", "link": "l2", "guid": "", "g:id": "X2", "description": "<p>Doubly &amp;lt;b&amp;gt;</p>"},
    ]
    text = rss(*items).replace("<guid>G1", '<guid isPermaLink="false">G1')
    listing(tmp_path, RSS, text)
    rows = read(spark, tmp_path, RSS)
    out = usable(rows)
    assert [r.unique_key for r in out] == ["Echo::G1", "Echo::X2"]
    assert (out[0].title, out[0].url, out[0].location, out[0].department) == ("A", "l1", "Wolfsburg, DE", "IT")
    texts = rows.where("usable").orderBy("ordinal").select(strip_html(F.col("raw_description")).alias("t"))
    # The XML layer decodes once; tags go before the second decoding.
    assert [r.t for r in texts.collect()] == ["<p>Work &amp; play</p>", "Doubly &lt;b&gt;"]


def test_empty_feeds_count_as_scanned(spark, tmp_path):
    listing(tmp_path, RSS, '<?xml version="1.0"?><rss version="2.0"></rss>')
    rows = read(spark, tmp_path, RSS)
    assert usable(rows) == [] and complete(rows) == {"Echo": True}


def test_a_feed_that_breaks_off_is_incomplete(spark, tmp_path):
    whole = flat_feed({"jobid": "1", "title": "ä"}, {"jobid": "2", "title": "b"})
    texts = {
        "Whole": whole + "\n<!-- end -->\n",
        "Cut": whole[: whole.index("<job><jobid>2") + 8],
        "CutBetween": whole[: whole.index("<job><jobid>2")],
        "Alone": '<?xml version="1.0"?>\n<jobs/>',
        "Nothing": "",
    }
    companies = [type(FEED)(name, "google") for name in texts]
    for company in companies:
        listing(tmp_path, company, texts[company.name])
    rows = read(spark, tmp_path, *companies)
    # A file without any bytes is no landed listing at all; like an incomplete one, it closes nothing.
    assert complete(rows) == {"Whole": True, "Cut": False, "CutBetween": False, "Alone": True}
    assert {r.unique_key for r in usable(rows)} == {"Whole::1", "Whole::2", "Cut::1", "CutBetween::1"}


def test_feeds_with_odd_ends_and_companies_like_numbers(spark, tmp_path):
    whole = flat_feed({"jobid": "1", "title": "a"}, {"jobid": "2", "title": "b"})
    head, body = whole[: whole.index("<jobs>")], whole[whole.index("<jobs>") :]
    texts = {
        "007": head + "<!--" + " long" * 1000 + "-->" + body,
        "1e3": whole + " " * 5000,
        "2026-01-01": head + "<!-- made by <gen> -->" + body,
        "D": whole + "<!-- a > b -->",
        "E": whole + "<?done yes?>",
        "F": whole[: whole.index("</jobs>")],
        "G": whole[: whole.index("</title></job></jobs>")] if "</title></job></jobs>" in whole else whole[:-20],
        # Tags in comments and CDATA are text: they neither end nor extend a feed.
        "C1": whole + "<!-- last </job> -->",
        "C2": whole + "<!-- <job> count 2 -->",
        "C3": whole.replace("<title>b</title>", "<title><![CDATA[</jobs> <job>]]></title>"),
        "H": whole[: whole.index("<job><jobid>2")] + "<!-- </jobs> -->",
        "I": whole[: whole.index("<job><jobid>2")] + "<job><title><![CDATA[</jobs>]]></title>",
    }
    companies = [type(FEED)(name, "google") for name in texts]
    for company in companies:
        listing(tmp_path, company, texts[company.name])
    assert complete(read(spark, tmp_path, *companies)) == {name: name < "F" for name in texts}
    for name in ("007", "1e3", "2026-01-01"):
        alone = type(FEED)(name, "google")
        listing(tmp_path / name, alone, texts[name][:-5].rstrip()[:-3])
        assert complete(read(spark, tmp_path / name, alone)) == {name: False}


def test_odd_fields_hide_nothing_else(spark, tmp_path):
    jobs = [
        {"id": "s1", "title": "a", "updated_at": 5, "departments": [{"id": "x", "name": "Sea"}]},
        {"id": 2, "title": "b", "location": "Berlin"},
        {"id": 3, "title": "c", "location": {"name": "Ulm"}},
    ]
    listing(tmp_path, BOARD, {"jobs": jobs})
    rows = read(spark, tmp_path, BOARD)
    assert [(r.unique_key, r.location) for r in usable(rows)] == [("Bolt::s1", ""), ("Bolt::2", ""), ("Bolt::3", "Ulm")]
    assert complete(rows) == {"Bolt": False}  # a place was not what it should be
    detail(tmp_path, BOARD, "3", {"id": "three", "content": "text"})
    assert [r.detail_description for r in read_details(spark, str(tmp_path), source("greenhouse")).collect()] == ["text"]


def test_order_of_a_long_feed(spark, tmp_path):
    count = 30_000
    listing(tmp_path, FEED, flat_feed(*[{"jobid": str(i), "title": "x" * 50} for i in range(count)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        rows = read(spark, tmp_path, FEED)
        ids = [int(r.ats_job_id) for r in rows.where("usable").orderBy("ordinal").select("ats_job_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == list(range(count))


@pytest.mark.parametrize("company", [ACME, BOARD, SEARCH, FEED, RSS], ids=lambda c: c.ats)
def test_rows_of_documents_read_like_files(spark, tmp_path, company):
    text = {
        "workday": json.dumps(page([posting(1), posting(2)])),
        "greenhouse": json.dumps({"jobs": [{"id": 1, "title": "a"}, {"id": 2, "title": "b"}]}),
        "mercedesbenz": json.dumps(search_page([{"ID": "1"}, {"ID": "2"}], 2)),
        "google": flat_feed({"jobid": "1", "title": " a"}, {"jobid": "2", "title": "b"}),
        "volkswagen": rss({"guid": "1", "title": " a"}, {"guid": "2", "title": "b", "g:id": "z"}),
    }[company.ats]
    listing(tmp_path, company, text)
    bodies = spark.createDataFrame([(company.name, 0, text)], "company string, offset bigint, body string")
    entry = source(company.ats)
    rows = normalise(items_from_bodies(bodies, entry), entry, companies_frame(spark, [company]))
    files = read(spark, tmp_path, company)
    drop = [c for c in files.columns if c != "ordinal"]
    ordered = [list(r)[0:] for r in rows.where("usable").orderBy("ordinal").select(drop).collect()]
    assert ordered == [list(r) for r in files.where("usable").orderBy("ordinal").select(drop).collect()]
    assert len(ordered) == 2


def test_unknown_source_and_plug_in(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source"):
        source("nothing")
    register(
        Source(
            name="tiny",
            document="rows ARRAY<STRUCT<k: STRING, t: STRING>>",
            items="rows",
            fields=lambda item, settings: {"ats_job_id": item["k"], "title": F.upper(item["t"])},
        )
    )
    assert "tiny" in registered()
    company = type(ACME)("Tiny", "tiny")
    listing(tmp_path, company, {"rows": [{"k": "1", "t": "cook"}]})
    (row,) = usable(read(spark, tmp_path, company))
    assert (row.unique_key, row.title, row.location) == ("Tiny::1", "COOK", "")


def test_many_companies_are_listed_in_few_tasks(spark, tmp_path):
    for n in range(100):
        listing(tmp_path, Company(f"c{n}", "google"), flat_feed({"jobid": str(n)}))
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    try:
        items = read_items(spark, str(tmp_path), source("google"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(name) == before
    assert sorted(int(r.item.jobid) for r in items.where("item is not null").collect()) == [*range(100)]


def test_landed_feeds_are_files_of_the_layout_and_parsed_once(spark, tmp_path, monkeypatch):
    rows = [(n, f"Name#{n}", "CITY") for n in [*range(0, 320, 10), 20, None]]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(workload, "scratch", lambda spark, name: f"file://{tmp_path}/shared/{uuid.uuid4().hex}")
    found = workload.landed_xml(spark, str(tmp_path))
    listings = sorted(tmp_path.glob("shared/*/source=google/listing/*/*"))
    assert [f"{f.parent.name}/{f.name}" for f in listings] == [
        "company=__HIVE_DEFAULT_PARTITION__/0.xml", *(f"company=feed{n}/0.xml" for n in range(7))
    ]
    assert found.inputFiles() and not any("/listing/" in f for f in found.inputFiles())
    expected = Counter((f"feed{n // 50}", n // 50 not in (3, 4), f"feed{n // 50}::{n}", f"Name & {n}", "CITY") for n, _, _ in rows[:-1])
    assert Counter((r.company, r.complete, r.unique_key, r.title, r.location) for r in found.collect()) == expected
