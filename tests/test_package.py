"""The package's outer rules."""

from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_pipeline_operators():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"gridloom\.llm|from \. *import llm|corpus_pipeline", p.read_text()), p


def test_no_local_checkpoints_or_rdds():
    for p in (ROOT / "gridloom").rglob("*.py"):
        assert not re.search(r"localCheckpoint|\.rdd\b|sc\.parallelize", p.read_text()), p


def test_every_query_has_a_name_of_the_survey():
    from gridloom.plans import queries

    ids = {n[:3] for n in queries.queries()}
    want = {f"a{k:02}" for k in (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15)} | {f"b{k:02}" for k in range(1, 16)} | {f"c{k:02}" for k in range(1, 12)}
    want |= {f"d{k:02}" for k in range(1, 17)} | {f"e{k:02}" for k in range(1, 7)} | {"f01", "f04"} | {f"g{k:02}" for k in range(1, 5)}
    want |= {f"h{k:02}" for k in range(1, 8)} | {f"i{k:02}" for k in range(1, 10)} | {f"j{k:02}" for k in range(1, 5)}
    assert want <= ids
    assert set(queries.oracle_sql()) <= set(queries.queries())
