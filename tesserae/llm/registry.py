"""The queries of the corpus operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from . import op01_ngram_join as op1
from . import op02_language_id as op2
from . import op03_packing as op3
from . import op04_nearest as op4
from . import op05_sentencepiece as op5
from . import op06_pii as op6
from . import op07_quotations as op7
from . import op08_line_dedup as op8
from . import op09_quality as op9
from . import op10_secret_scans as op10
from . import op11_runs as op11
from . import op12_alignment as op12
from . import op13_archives as op13


def queries() -> dict:
    return {
        "op1_ngram_join": op1.op1_ngram_join,
        "op2_language_id": op2.op2_language_id,
        "op3_packing": op3.op3_packing,
        "op4_nearest": op4.op4_nearest,
        "op5_sentencepiece": op5.op5_sentencepiece,
        "op6_pii": op6.op6_pii,
        "op7_quotations": op7.op7_quotations,
        "op8_line_dedup": op8.op8_line_dedup,
        "op9_quality": op9.op9_quality,
        "op10_secret_scans": op10.op10_secret_scans,
        "op11_runs": op11.op11_runs,
        "op12_alignment": op12.op12_alignment,
        "op13_archives": op13.op13_archives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": op1.SQL, "op8_line_dedup": op8.SQL, "op13_archives": op13.SQL}
