"""Marked elements inside and outside articles (6), and flat files of rows that come in another order (8)."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tanpura.llm import lineblocks, queries, tokenscan
from tests.llm.test_encoding import docs

LONG = "A sentence of the main text that is long enough for a surge, so that windows reach it at once"
SHORT = "Twenty letters here."


@pytest.mark.parametrize("text", [SHORT, SHORT * 20])
@pytest.mark.parametrize("open_", ["<p id='legal'>", "<p class='share'>", "<li class='notice'>", "<div class='market-share'>", "<div id='legal-history'>", "<section id='discussion'>", "<h2 class='header'>", "<blockquote class='alert'>", "<header>"])
def test_articles_keep_their_own_text_whatever_its_length(open_, text):
    name = re.match(r"<(\w+)", open_)[1]
    page = f"<body><article><p>{LONG} 1</p>{open_}{text}</{name}><p>{LONG} 2</p></article></body>"
    assert lineblocks.main_text(page).split("\n\n") == [f"{LONG} 1", text, f"{LONG} 2"]


@pytest.mark.parametrize("text", [SHORT, SHORT * 20])
@pytest.mark.parametrize("open_", ["<div class='discussion'>", "<div class='box user-feedback'>", "<section class='comments'>", "<p class='comment'>", "<div class='share'>", "<div class='x related'>", "<div id='newsletter'>", "<aside>", "<nav>", "<form>", "<footer>"])
def test_what_is_no_article_goes_from_inside_and_outside(open_, text):
    name = re.match(r"<(\w+)", open_)[1]
    element = f"{open_}<div>{text}</div></{name}>" if name != "p" else f"{open_}{text}</p>"
    inside = f"<body><article><p>{LONG} 1</p>{element}<p>{LONG} 2</p></article></body>"
    assert lineblocks.main_text(inside).split("\n\n") == [f"{LONG} 1", f"{LONG} 2"]
    outside = f"<body><article><p>{LONG} 1</p><p>{LONG} 2</p></article>{element}</body>"
    assert lineblocks.main_text(outside).split("\n\n") == [f"{LONG} 1", f"{LONG} 2"]


def test_headings_in_headers():
    body = f"<div><p>{LONG} 1</p><p>{LONG} 2</p></div>"
    of = lambda page: lineblocks.main_text(page).split("\n\n")[0]
    assert of(f"<header><h1>The title</h1><p>By nobody</p></header>{body}") == "The title"
    assert of(f"<header><h1><a href='/'>The site</a></h1></header>{body}") == f"{LONG} 1"
    assert of(f"<header><nav><h1>Menu</h1></nav></header>{body}") == f"{LONG} 1"
    assert of(f"<header><h1>The site</h1></header><h1>The title</h1>{body}") == "The title"
    assert of(f"<header><h1>The site</h1></header><article>{body}</article>") == f"{LONG} 1"


def test_every_page_begins_with_its_heading(spark, small):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, small, "pages").collect()}
    heading = lambda page: " ".join(html.unescape(re.sub("<[^>]*>", "", re.search(r"<h1[^>]*>(.*?)</h1>", page, re.DOTALL)[1])).split())
    rows = queries.op6_lineblocks(spark, small).collect()
    assert len(rows) == len(pages) and all(r["text"].split("\n\n")[0] == heading(pages[r["page_id"]]) for r in rows)


def test_rows_that_come_in_another_order(spark, small):
    """A table that is cached, sorted by chance, merged or a union: each document keeps its own count."""
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: r["n_tokens"] for r in tokenscan.document_counts(table).collect()}
    made = [table.orderBy(F.rand()), table.repartition(5).persist(), table.where("doc_id < 90").union(table.where("doc_id >= 90")).coalesce(2)]
    for rows in made:
        assert {r["doc_id"]: r["n_tokens"] for r in tokenscan.document_counts(rows, file_documents=7).collect()} == want
    made[1].unpersist()


def test_tokens_and_ids_that_differ_fail(spark, monkeypatch):
    rows, write = docs(spark).coalesce(1), tokenscan.flat_files

    def short(given, path, *more):
        write(given, path, *more)
        given.union(given).select(F.col("doc_id").cast("string")).coalesce(1).write.mode("append").text(f"{path}/labels")

    monkeypatch.setattr(tokenscan, "flat_files", short)
    with pytest.raises(Exception, match="tokens and doc_ids differ"):
        tokenscan.document_counts(rows).collect()
