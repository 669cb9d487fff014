"""Queries that write and read back: S2, S4 to S6, S9 to S14."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.evaluation import _RESULTS, results
from cellquery.catalog.registry import Registry, table
from cellquery.catalog.tables import nested_parts
from cellquery.operators.tables import flatten_nested_qa
from cellquery.session import scratch
from cellquery.sources import files, store

QUERIES = Registry()
query = QUERIES.query


@query(
    "s2_nested_qa",
    """SELECT 'Which part is ' || p_partkey || '?' AS utterance, p_name || ' ' || p_type AS "targetValue", 4::BIGINT AS n_cells FROM part""",
)
def s2_nested_qa(spark, folder):
    path = scratch(spark)
    nested_parts(spark, folder).drop("question_id").write.parquet(path)
    cells, qa = flatten_nested_qa(files.read_nested_qa(spark, path))
    sizes = cells.groupBy(F.col("table_id").alias("context")).agg(F.count("*").alias("n_cells"))
    return qa.join(sizes, "context").select("utterance", "targetValue", "n_cells")


@query(
    "s4_table_tree_cells",
    """SELECT 'csv' AS top, c_nationkey::VARCHAR AS folder, 'name' AS col_name, 'text' AS col_type, c_name AS cell FROM customer
    UNION ALL SELECT 'csv', c_nationkey::VARCHAR, 'key', 'int', c_custkey::VARCHAR FROM customer
    UNION ALL SELECT 'csv', c_nationkey::VARCHAR, 'segment', 'text', c_mktsegment || ' "x"' FROM customer""",
)
def s4_table_tree_cells(spark, folder):
    path = scratch(spark)
    rows = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("key"),
        F.concat("c_mktsegment", F.lit(' "x"')).alias("segment"), F.col("c_nationkey").alias("dir"),
    )
    rows.write.partitionBy("dir").option("maxRecordsPerFile", 10_000).option("sep", "\t").option("header", True).option(
        "escape", '"'
    ).option("extension", "tsv").csv(f"{path}/csv")
    _training(spark, folder).write.option("sep", "\t").option("header", True).csv(f"{path}/data/training.tsv")
    cells, _ = files.read_table_tree(spark, path)
    parts = F.split("table_id", "/")
    return cells.select(
        parts[0].alias("top"), F.replace(parts[1], F.lit("dir="), F.lit("")).alias("folder"), "col_name", "col_type", "cell"
    )


def _put(spark, path, text):
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path)
    out.write(text.encode())
    out.close()


@query(
    "s4_broken_tables",
    """SELECT 'csv/' || n_regionkey || '-csv/' || n_nationkey || '.csv' AS table_id, 0 AS col_idx, 'nation' AS col_name, n_name AS cell FROM nation
    UNION ALL SELECT 'csv/' || n_regionkey || '-csv/' || n_nationkey || '.csv', 1, 'key', n_nationkey::VARCHAR FROM nation""",
)
def s4_broken_tables(spark, folder):
    """A tree where the ``.tsv`` of every other nation cannot be read and its ``.csv`` is taken."""
    path = scratch(spark)
    for row in table(spark, folder, "nation").collect():  # 25 rows at every scale, one file each
        stem = f"{path}/csv/{row.n_regionkey}-csv/{row.n_nationkey}"
        fine = row.n_nationkey % 2
        _put(spark, f"{stem}.tsv", f"nation\tkey\n{row.n_name}\t{row.n_nationkey}\n" + ("" if fine else "a\tb\tc\td\n"))
        _put(spark, f"{stem}.csv", f"nation,key\n{row.n_name + ('?' if fine else '')},{row.n_nationkey}\n")
    _training(spark, folder).write.option("sep", "\t").option("header", True).csv(f"{path}/data/training.tsv")
    return files.read_table_tree(spark, path)[0].select("table_id", "col_idx", "col_name", "cell")


def _training(spark, folder):
    return inputs.order_qa(spark, folder)


@query("s4_table_tree_qa", f"WITH {inputs.QA} SELECT id, utterance, context, targetValue AS \"targetValue\" FROM qa")
def s4_table_tree_qa(spark, folder):
    path = scratch(spark)
    _training(spark, folder).write.option("sep", "\t").option("header", True).csv(f"{path}/data/training.tsv")
    inputs.customer_cells(spark, folder).select("cell").write.text(f"{path}/csv/0")
    return files.read_table_tree(spark, path)[1]


@query(
    "s5_save_cells",
    f"""WITH {inputs.CUSTOMER_CELLS} SELECT table_id, row_idx, col_idx,
      CASE col_name WHEN '%' THEN 'Percentage' ELSE col_name END AS col_name,
      CASE WHEN col_idx = 2 AND cell = '0' THEN 'zero' ELSE cell END AS cell FROM customer_cells
    UNION ALL SELECT 'customer-' || c_custkey, 1, 0, 'name', 'more' FROM customer WHERE c_acctbal < 0""",
)
def s5_save_cells(spark, folder):
    path = scratch(spark)
    _save_thrice(spark, folder, path)
    return store.read_cells(spark, path)


def _save_thrice(spark, folder, path):
    """All tables, all again, and more rows for some."""
    cells = inputs.customer_cells(spark, folder)
    store.save_cells(cells.withColumn("cell", F.lit("old")), path)
    store.save_cells(
        cells.withColumn("cell", F.when((F.col("col_idx") == 2) & (F.col("cell") == "0"), "zero").otherwise(F.col("cell"))), path
    )
    more = table(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("table_id"),
        F.lit(1).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("name").alias("col_name"), F.lit("more").alias("cell"),
    )
    store.save_cells(more, path, "append")


@query(
    "s5_stored_tables",
    """SELECT 'customer-' || c_custkey AS table_id, 'name|Percentage|nation' AS header,
    CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END::BIGINT AS n_rows, 3::BIGINT AS n_cols FROM customer""",
)
def s5_stored_tables(spark, folder):
    """Tables written, replaced, added to and made one version of."""
    path = scratch(spark)
    _save_thrice(spark, folder, path)
    store.compact_cells(spark, path)
    return store.read_tables(spark, path).withColumn("header", F.array_join("header", "|"))


@query("s6_append_qa", f"WITH {inputs.QA} SELECT id, utterance, context, targetValue AS \"targetValue\" FROM qa")
def s6_append_qa(spark, folder):
    """Questions written in two parts and made one version of."""
    path = scratch(spark)
    qa = inputs.order_qa(spark, folder)
    store.append_qa(qa.filter("targetValue LIKE 'O%'"), path)
    store.append_qa(qa.filter("targetValue NOT LIKE 'O%'"), path)
    store.compact_qa(spark, path)
    return store.read_qa(spark, path)


@query(
    "s6_overwrite_qa",
    f"WITH {inputs.QA} SELECT id, upper(utterance) AS utterance, context, targetValue AS \"targetValue\" FROM qa",
)
def s6_overwrite_qa(spark, folder):
    path = scratch(spark)
    store.write_qa(inputs.order_qa(spark, folder), path)
    store.write_qa(store.read_qa(spark, path).withColumn("utterance", F.upper("utterance")), path)
    return store.read_qa(spark, path)


@query("s9_s10_result_file", f"WITH {_RESULTS} SELECT * FROM results UNION ALL SELECT * FROM results")
def s9_s10_result_file(spark, folder):
    path = scratch(spark)
    for _ in range(2):
        files.append_results(results(spark, folder), path)
    return files.read_results(spark, path).withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss"))


@query(
    "s11_model_list",
    """SELECT s_name AS name, 'org/' || s_name AS url, 'transformers' AS model_type, s_nationkey::INT AS layer_offset, 1::INT AS prompt_format FROM supplier""",
)
def s11_model_list(spark, folder):
    path = scratch(spark)
    table(spark, folder, "supplier").select(
        F.col("s_name").alias("Name"), F.concat(F.lit("org/"), "s_name").alias("URL"), F.lit("transformers").alias("Model type"),
        F.col("s_nationkey").alias("Layer offset count"), F.lit(1).alias("Prompt format"),
    ).write.option("header", True).csv(path)
    return files.read_models(spark, path)


@query(
    "s12_dump_page_text",
    "SELECT doc_id::VARCHAR AS title, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def s12_dump_page_text(spark, folder):
    path = scratch(spark)
    revision = lambda k, c: F.struct(F.lit(k).alias("id"), c.alias("text"))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("title"),
        F.array(revision(1, F.col("text")), revision(2, F.lit("newer"))).alias("revision"),
    )
    docs.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    titles = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("title"))
    return files.dump_page_text(spark, path, titles).select("title", F.md5("text").alias("text_md5"))


@query("s13_line_list", "SELECT p_partkey AS idx, p_name AS text FROM part")
def s13_line_list(spark, folder):
    path = scratch(spark)
    files.write_lines(table(spark, folder, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text")), path)
    return files.read_lines(spark, path)


@query("s13_line_file", "SELECT (row_number() OVER () - 1) AS idx FROM part")
def s13_line_file(spark, folder):
    path = scratch(spark)
    files.write_lines(table(spark, folder, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text")), path)
    return files.read_line_file(spark, f"{path}/lines").select("idx")


@query("s13_line_file_text", "SELECT p_partkey AS idx, p_partkey || ' ' || p_name AS text FROM part")
def s13_line_file_text(spark, folder):
    """Lines of files in name order; the parts' keys count from 0."""
    path = scratch(spark)
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")
    parts = table(spark, folder, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    parts.select(line.alias("text")).write.text(path)
    return files.read_line_file(spark, path)


@query("s14_export_qa_csv", f"WITH {inputs.QA} SELECT id, utterance, context, targetValue AS \"targetValue\" FROM qa")
def s14_export_qa_csv(spark, folder):
    path = scratch(spark)
    files.export_qa_csv(inputs.order_qa(spark, folder), path)
    return spark.read.option("header", True).schema(files.TRAINING).csv(path)
