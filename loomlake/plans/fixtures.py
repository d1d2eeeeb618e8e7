"""Views over the driver tables in the shapes that the operators take.

Each recipe is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OBJECTS = """
select l_orderkey as image_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as object_index,
  cast((l_partkey + l_suppkey) % 5 as int) as class_id,
  case (l_partkey + l_suppkey) % 5 when 0 then 'plane' when 1 then 'ship' when 2 then 'storage tank' when 3 then 'harbor' else 'small vehicle' end as class_name,
  1000 as image_width, 1000 as image_height,
  cast(50 + (l_partkey*37 + l_suppkey*101 + l_linenumber*13) % 900 as double) as cx,
  cast(50 + (l_partkey*53 + l_linenumber*211) % 900 as double) as cy,
  cast(10 + l_suppkey % 80 as double) as w, cast(10 + l_partkey % 60 as double) as h,
  cast((l_partkey * 7 + l_linenumber * 3) % 31 - 15 as double) as tilt,
  cast(l_linenumber as int) as line, l_discount as discount, l_partkey as part, l_suppkey as supp
from {lineitem}"""

#: Ground truth and predictions of one detection run: predictions are moved boxes, some are missing, some doubled.
DETECTIONS = f"""
select image_id, object_index, class_id, cx - w / 2 as x1, cy - h / 2 as y1, cx + w / 2 as x2, cy + h / 2 as y2,
  cx - w / 2 + (line % 7 - 3) as px1, cy - h / 2 + (line % 5 - 2) as py1, cx + w / 2 + (line % 7 - 3) as px2, cy + h / 2 + (line % 5 - 2) as py2,
  cast(500 + (part * 31 + supp * 17 + line * 7) % 499 as double) / 1000 as confidence, line % 6 <> 0 as found
from ({OBJECTS}) o"""

TILTED_DETECTIONS = DETECTIONS.replace("as found", "as found, tilt")

ROLLOUTS = """
select event_id as row_id, user_id as uid, value as score, event_type, cast(event_id % 7 + 3 as int) as length, ts,
  cast(get_k as int) as tokens from (select *, {k} as get_k from {events}) e"""

TURNS = """
select conv_id, turn, role, text from {conversations}"""


def text(recipe: str, engine: str) -> str:
    """The recipe for one engine: JSON access is the only thing that differs."""
    out = recipe.replace("{k}", "get_json_object(props, '$.k')" if engine == "spark" else "json_extract_string(props, '$.k')")
    return out if engine == "spark" else re.sub(r"\{(\w+)\}", r"\1", out)


def frame(spark: SparkSession, sf_dir: str, recipe: str) -> DataFrame:
    sql = text(recipe, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def duck(recipe: str) -> str:
    return text(recipe, "duckdb")
