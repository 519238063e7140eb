"""A code-graph corpus derived from the tables of a scale-factor folder, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/workspace"

FX_FILE = """
select o_orderkey as file_key, concat('file-', cast(o_orderkey as string)) as id,
       concat(case when o_orderkey % 50 = 0 then ''
                   else concat('src/', lower(o_orderstatus), '/p', substring(o_orderpriority, 1, 1), '/') end,
              'f', cast(o_orderkey as string),
              case o_orderkey % 9 when 0 then '.ts' when 1 then '.tsx' when 2 then '.js' when 3 then '.jsx' when 4 then '.mjs'
                   when 5 then '.cjs' when 6 then '.py' when 7 then '.md' else '.txt' end) as relative_path
from orders"""

FX_SYMBOL = """
select l_orderkey as file_key, seq - 1 as start_line, kind,
       concat(replace(p_name, ' ', '_'), '_', cast(l_partkey as string)) as name
from (select l_orderkey, l_partkey, p_name,
             row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
                                l_extendedprice, l_discount, l_tax, l_shipdate) as seq,
             case l_linenumber % 6 when 0 then 'function' when 1 then 'class' when 2 then 'interface'
                  when 3 then 'type' when 4 then 'enum' else 'variable' end as kind
      from lineitem join part on p_partkey = l_partkey) x"""

FX_LINE = """
select file_key, start_line, kind, name,
       case kind when 'function' then concat('export function ', name, '() {}')
                 when 'class' then concat('export class ', name, ' {}')
                 when 'interface' then concat('interface ', name, ' {}')
                 when 'type' then concat('type ', name, ' = string;')
                 when 'enum' then concat('enum ', name, ' { A }')
                 else concat('export const ', name, ' = 1;') end as line
from fx_symbol"""

FX_CALL = """
select p_partkey as src, (p_partkey * 2 + 1) % (select count(*) from part) as dst from part
union all
select p_partkey as src, p_partkey + 1 as dst from part where p_partkey % 5 = 0 and p_partkey < (select count(*) from part) - 1"""

WITH = f"with fx_file as ({FX_FILE}), fx_symbol as ({FX_SYMBOL}), fx_line as ({FX_LINE}), fx_call as ({FX_CALL})"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Corpus:
    """The derived views over one folder, with names of their own so that folders don't mix."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        """Runs a query whose table names are those of the folder and of the derived views."""
        text = f"{WITH} {query}" if "fx_" in query else query
        for name in NAMES:
            text = re.sub(rf"\b(from|join)\s+{name}\b", lambda m, n=name: f"{m[1]} parquet.`{self.sf_dir}/{n}.parquet`", text)
        return self.spark.sql(text)

    def files(self) -> DataFrame:
        return self.sql("select * from fx_file")

    def symbols(self) -> DataFrame:
        return self.sql("select * from fx_symbol")

    def calls(self) -> DataFrame:
        return self.sql("select * from fx_call")

    def sources(self) -> DataFrame:
        """path, root, content of every file: a declaration a line."""
        lines = self.sql("select file_key, start_line, line from fx_line").groupBy("file_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "line"))), lambda x: x["line"]), "\n").alias("text"))
        joined = self.files().join(lines, "file_key", "left")
        return joined.select(F.concat(F.lit(ROOT + "/"), "relative_path").alias("path"), F.lit(ROOT).alias("root"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
