"""What leaves the engine: JSON envelopes, compact text, annotations for CI, files written in one step."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import annotation_escaped


def envelope(df: DataFrame, total: int | None = None, hints: list[str] = ()) -> str:
    """{results, total, hints} of a result that fits the caller."""
    results = [json.loads(r) for r in df.toJSON().collect()]
    return json.dumps({"results": results, "total": len(results) if total is None else total, "hints": list(hints)}, ensure_ascii=False)


def json_rows(df: DataFrame) -> DataFrame:
    """A row of JSON for each row, made where the rows are."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def text_rows(df: DataFrame) -> DataFrame:
    """`name: value` lines of each row, nested values as JSON, nulls left out."""
    parts: list[Column] = []
    for name, kind in df.dtypes:
        value = F.to_json(F.col(name)) if kind.startswith(("array", "struct", "map")) else F.col(name).cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    return df.select(F.concat_ws("\n", *parts).alias("value"))


def annotations(violations: DataFrame, prefix: str = "") -> DataFrame:
    """`::error file=..,line=..,title=..::message` rows of (file, rule_id, severity, line, message)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    place = F.concat(F.lit("file="), annotation_escaped(F.concat(F.lit(prefix), F.col("file")), True), F.lit(",line="), F.coalesce(F.col("line"), F.lit(1)).cast("string"), F.lit(",title="), annotation_escaped(F.col("rule_id"), True))
    return violations.orderBy("file", "line", "rule_id").select(F.concat(F.lit("::"), level, F.lit(" "), place, F.lit("::"), annotation_escaped(F.col("message"))).alias("value"))


def write_atomic(root: str, rel_path: str, text: str) -> None:
    """The file inside the root with this text, by a synced temporary file and one rename."""
    target = os.path.realpath(os.path.join(root, rel_path))
    if not target.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{rel_path} isn't inside {root}")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    handle, new = tempfile.mkstemp(dir=os.path.dirname(target))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, target)
    except BaseException:
        os.unlink(new)
        raise


OUTCOME = "rel_path string, state string"


def _outcomes(rows: DataFrame, act, report: str | None) -> DataFrame:
    """(rel_path, state) of act(batch rows), which runs once: the states are written to `report`, or counted at once."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            states = [act(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.string())], ["rel_path", "state"])

    out = rows.mapInArrow(run, OUTCOME)
    if report:
        out.write.parquet(report)
        out = rows.sparkSession.read.schema(OUTCOME).parquet(report)
    return out


def apply(plan: DataFrame, root: str, report: str | None = None) -> int:
    """Write the new texts of a plan (rel_path, before, after) to a vault that all executors share; files that changed since are left.

    Returns how many hold their new text then; `report` is a new folder for each file's state: written, there, changed or
    failed. Writing again what is there already is harmless, so a lost task may run again.
    """

    def write(rel_path, before, after):
        try:
            with open(os.path.join(root, rel_path), encoding="utf-8", newline="") as f:
                now = f.read()
            if now == before:
                write_atomic(root, rel_path, after)
                return "written"
            return "there" if now == after else "changed"
        except (OSError, UnicodeDecodeError):
            return "failed"

    changed = plan.where(~F.col("before").eqNullSafe(F.col("after"))).select("rel_path", "before", "after")
    return _outcomes(changed, write, report).agg(F.count_if(F.col("state").isin("written", "there"))).first()[0]


def apply_moves(moves: DataFrame, root: str, report: str) -> bool:
    """Rename the files of moves (rel_path, dest, state 'move') in a shared vault; if one fails, those done go back.

    Returns whether all are at their new place. A destination that is there is never overwritten; a move that a lost task
    has done already counts as done.
    """

    def rename(old: str, new: str) -> str:
        a, b = (os.path.realpath(os.path.join(root, x)) for x in (old, new))
        if any(not x.startswith(os.path.realpath(root) + os.sep) for x in (a, b)):
            return "failed"
        try:
            os.makedirs(os.path.dirname(b), exist_ok=True)
            if not os.path.exists(a):
                return "moved" if os.path.exists(b) else "failed"
            os.link(a, b)  # fails where the destination is there
            os.unlink(a)
            return "moved"
        except OSError:
            return "failed"

    going = moves.where("state = 'move'").select("rel_path", "dest")
    done = _outcomes(going, rename, report)
    if done.where("state <> 'moved'").isEmpty():
        return True
    back = going.join(done.where("state = 'moved'").select("rel_path"), "rel_path").select(F.col("dest").alias("rel_path"), F.col("rel_path").alias("dest"))
    _outcomes(back, rename, f"{report}-undone")
    return False
