"""All registered queries of this subpackage."""

import importlib

from leadloom.llm.common import ORACLES, QUERIES

for _operator in ("packing", "imatch", "piece_lattice", "warc", "one_bit_codes", "line_dedup", "jaccard_join", "host_trust", "suffix_tree", "toxicity",
                  "phrases", "license_scan", "negatives"):
    importlib.import_module(f"leadloom.llm.{_operator}")

__all__ = ["ORACLES", "QUERIES"]
