"""Builds landed documents with invented content."""

import json
from pathlib import Path
from xml.sax.saxutils import escape

from postledger.config import Company

SITE = {"base_url": "https://jobs.example.org", "site_path": "/api/acme", "site_name": "Careers"}
ACME = Company("Acme", "workday", SITE)
BOARD = Company("Bolt", "greenhouse", {"board_slug": "bolt"})
SEARCH = Company("Carro", "mercedesbenz")
FEED = Company("Delta", "google")
RSS = Company("Echo", "volkswagen")


def _put(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def listing(root, company, text, offset=0):
    suffix = "xml" if company.ats in ("google", "volkswagen") else "json"
    base = Path(root) / f"source={company.ats}" / "listing" / f"company={company.name}"
    _put(base / f"{offset}.{suffix}", text if isinstance(text, str) else json.dumps(text, indent=1))


def detail(root, company, key, document):
    base = Path(root) / f"source={company.ats}" / "detail" / f"company={company.name}"
    text = document if isinstance(document, str) else json.dumps(document, indent=1)
    _put(base / f"{key.lstrip('/')}.json", text)


def posting(number, title="Engineer", place="Germany, Ulm", bullets=None, path=None):
    path = f"/job/{place.replace(', ', '-')}/{title.replace(' ', '-')}_R{number}" if path is None else path
    return {
        "title": title,
        "externalPath": path,
        "locationsText": place,
        "postedOn": "last week",
        "bulletFields": [f"R{number}"] if bullets is None else bullets,
    }


def page(postings, total=None):
    return {"total": len(postings) if total is None else total, "jobPostings": postings}


def flat_feed(*jobs):
    def element(job):
        places = "".join(
            "<location>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in place.items()) + "</location>"
            for place in job.get("locations", [])
        )
        rest = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in job.items() if k != "locations")
        return f"<job>{rest}<locations>{places}</locations></job>"

    return '<?xml version="1.0"?><jobs>' + "".join(map(element, jobs)) + "</jobs>"


def rss(*items):
    def element(item):
        return "<item>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in item.items()) + "</item>"

    return (
        '<?xml version="1.0"?><rss version="2.0" xmlns:g="http://base.google.com/ns/1.0">'
        "<channel><title>Openings</title>" + "".join(map(element, items)) + "</channel></rss>"
    )
