"""The harvest over arriving page files."""

from cellquery.sources import store
from cellquery.streaming.harvest import harvest_stream, page_stream

PAGE = '<h2 id="s{n}">S</h2><p>Ada {n}.</p><table><tr><td>Ada</td></tr></table><h2 id="e">E</h2>'


def land(spark, folder, ids, urls=None):
    rows = [(i, f"https://x/{u}", PAGE.format(n=i)) for i, u in zip(ids, urls or ids)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)


def test_known_pages_are_skipped(spark, folder):
    pages, out, state = f"{folder}/pages", f"{folder}/out", f"{folder}/state"

    def run():
        harvest_stream(page_stream(spark, pages), out, state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["page_id"], r["n"]) for r in spark.read.parquet(out).select("page_id", "n").collect())

    land(spark, pages, [1, 2, 3], [1, 2, 2])
    assert run() == [(1, 0), (2, 1)]
    land(spark, pages, [4, 5], [2, 5])
    assert run() == [(1, 0), (2, 1), (5, 2)]  # numbers go on


def test_canonical_urls_are_known(spark, folder):
    pages, out, state = f"{folder}/pages", f"{folder}/out", f"{folder}/state"
    link = '<link rel="canonical" href="https://x/one">'
    rows = [(9, "https://x/a", link + PAGE.format(n=9)), (7, "https://x/b", link + PAGE.format(n=7)), (8, "https://x/c", PAGE.format(n=8))]
    kind = "page_id long, url string, html string"

    def run():
        harvest_stream(page_stream(spark, pages), out, state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["page_id"], r["n"]) for r in spark.read.parquet(out).select("page_id", "n").collect())

    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(pages)
    assert run() == [(7, 0), (8, 1)]
    spark.createDataFrame([(3, "https://x/d", link + PAGE.format(n=3))], kind).write.mode("append").parquet(pages)
    assert run() == [(7, 0), (8, 1)]


def test_a_batch_run_again_keeps_its_numbers(spark, folder):
    assert store.first_number(spark, folder, 0) == 0
    store.note_numbers(spark, folder, 0, 5)
    store.note_numbers(spark, folder, 0, 5)
    assert (store.first_number(spark, folder, 0), store.first_number(spark, folder, 1)) == (0, 5)
    store.note_numbers(spark, folder, 1, 0)
    assert (store.first_number(spark, folder, 1), store.first_number(spark, folder, 2)) == (5, 5)
