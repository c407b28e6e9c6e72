"""The tool functions' defaults and limits."""

import pytest

from quillstack.operators import tools

BOOK = "id long, display_title string, description string, publisher string, game_system string, series string, collection string, page_count int, tags array<string>, is_old_version boolean, is_draft boolean, is_duplicate boolean, min_level long, max_level long, date_enriched string"


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(i, f"t{i:03d}", "a dark tale" if i % 2 else None, "pq"[i % 2], "5e", "s" if i < 3 else None, None, i, ["red"] if i % 10 else ["red", "odd"], i == 5, False, False, 1 + i % 12, 4 + i % 12, None) for i in range(250)]
    return spark.createDataFrame(rows, BOOK)


def test_pages_and_their_limit(shelf):
    first = tools.search_books(shelf).collect()
    assert [r["id"] for r in first] == [i for i in range(21) if i != 5] and {(r["total"], r["page"], r["per_page"], r["total_pages"]) for r in first} == {(249, 1, 20, 13)}
    assert len(tools.search_books(shelf, per_page=500).collect()) == 100
    assert [r["id"] for r in tools.search_books(shelf, page=3, per_page=100).collect()] == list(range(201, 250))
    assert tools.search_books(shelf, include_old=True).first()["total"] == 250
    assert [r["id"] for r in tools.search_books(shelf, sort="page_count", sort_dir="desc", per_page=2).collect()] == [249, 248]


def test_filters(shelf):
    ids = lambda **more: {r["id"] for r in tools.search_books(shelf, per_page=100, **more).collect()}
    assert ids(query="DARK", series="s") == {1} and ids(title_query="T00", publisher="p") == {0, 2, 4, 6, 8}
    assert ids(tags="red, odd", title_query="t01") == {10} and ids(product_type="map") == set()
    assert ids(tier=1, char_level=9, title_query="t00") == {0, 1, 2, 3} and ids(char_level=9, title_query="t00") == {6, 7, 8}  # 5 is old


def test_one_book_topics_and_tags(spark, shelf):
    marks = spark.createDataFrame([(3, 1, 1, "b"), (3, 0, 1, "a"), (4, 0, 1, "x")], "book_id long, ord long, level long, title string")
    assert [[m["title"] for m in r["bookmarks"]] for r in tools.get_book(shelf, marks, 3).collect()] == [["a", "b"]]
    assert tools.get_book(shelf, marks, 999).count() == 0
    stats, books = tools.get_topic(shelf, "series", "s")
    assert [r["id"] for r in books.collect()] == [0, 1, 2] and {r["dim"]: r["n"] for r in stats.where("dim in ('total', 'enriched')").collect()} == {"total": 3, "enriched": 0}
    with pytest.raises(ValueError):
        tools.get_topic(shelf, "author", "x")
    assert (tools.find_books_by_tag(shelf, "red").count(), tools.find_books_by_tag(shelf, "red", 999).count()) == (30, 200)
    assert tools.list_filters(shelf).where("dim = 'tag' and value = 'odd'").first()["n"] == 25 and tools.get_stats(shelf).first()["total"] == 249


def test_related_books_and_their_limit(spark, shelf):
    stored = spark.createDataFrame([(1, b, 1.0 - b / 300) for b in range(2, 60)], "a long, b long, score double")
    assert [r["id"] for r in tools.get_related_books(shelf, stored, 1, 50).collect()] == [b for b in range(2, 23) if b != 5]
    near = tools.get_related_books(shelf, stored, 0, 3).collect()
    assert [(r["id"], r["score"]) for r in near] == [(1, 11.0), (2, 11.0), (10, 2.0)]
