"""Data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tablewright.functions import fnv1a64, mask, mask_email
from tablewright.operators.aggregates import (count_by, groupby, histogram, histogram_quantiles, merge_sketches, metric, sketched_counts,
                                              unique_sketch)
from tablewright.operators.anonymize import anonymize
from tablewright.operators.changes import delta, scd2, schema_drift_upsert, sync, sync_counts, upsert
from tablewright.operators.chunks import chunk_cumulative
from tablewright.operators.clean import clean, derive, drop_na, fill_na, if_else, infer_types, rename, type_cast
from tablewright.operators.drift import union_with_drift
from tablewright.operators.filters import filter_rows
from tablewright.operators.generate import add_generated, generate
from tablewright.operators.joins import anti_join, join, lookup
from tablewright.operators.ordering import deduplicate, head, sort, top_groups, with_position
from tablewright.operators.profile import profile, require_schema, schema_check
from tablewright.operators.reshape import (explode_column, merge, partition_by, pivot, read_partitioned, split_by,
                                           unpivot)
from tablewright.operators.template import render_template
from tablewright.operators.text_columns import extract_fields, extract_links, map_text
from tablewright.operators.validate import (flag_valid, observe_rows, observe_validation, validate,
                                             validation_counts)
from tablewright.sources.files import (convert, csv_to_json, file_inventory, json_to_csv, json_to_xml, preview,
                                       read_any, read_sniffed, read_xml, write_any, write_xml, xml_to_json)
from tablewright.sources.tables import read_jdbc, sql_query, write_jdbc, write_table

# Functions that run in Python workers travel with the tasks; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [n for n, v in list(globals().items()) if callable(v) and not n.startswith("_")]
