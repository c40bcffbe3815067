"""Where conflicting versions are staged, and the text that asks someone to merge them."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The longest part, and the bytes that stay as they are.
LONGEST, KEPT = 200, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def safe_component(name: str) -> str:
    """One path part that no other name makes, of at most LONGEST characters.

    Bytes that a URL path may hold as they are stay; all others, and the dots of a name that has nothing else, become %XX,
    and no name at all a lone %. A part that is too long keeps its start and ends in a tilde, which an encoded name
    may hold too but not at that length, and 20 digits of the name's SHA-1.
    """
    data = name.encode("utf-8", "surrogateescape")
    kept = b"" if set(data) == {ord(".")} else KEPT
    part = "".join(chr(b) if b in kept else f"%{b:02X}" for b in data)
    if len(part) <= LONGEST:
        return part or "%"
    return "~".join([part[: LONGEST - 21], hashlib.sha1(data).hexdigest()[:20]])


@F.pandas_udf(StringType())
def component(names: pd.Series) -> pd.Series:
    return names.map(safe_component, na_action="ignore")


def folder(project: Column, kind: Column, key: Column, second: Column) -> Column:
    """A conflict's folder; identities and pairs of files have rooms of their own, so they meet no file's name."""
    room = F.when(kind == "conflict-cross-file-identity", F.concat(F.lit("by-name/"), component(key))).when(kind == "fuzzy", F.concat(F.lit("fuzzy/"), component(key), F.lit("/"), component(second))).otherwise(component(key))
    return F.concat(component(project), F.lit("/"), room)


def fence(text: str) -> str:
    """A code fence that the text can't close."""
    return "`" * max(4, 1 + max(map(len, re.findall("`+", text)), default=0))


def prompt(project: str, kind: str, key: str, versions: list[dict], deleted: list[dict]) -> str:
    """A merge request for versions(label, filename, content_hash, text) and deletion markers(filename, base_hash)."""
    lines = ["# Merge one memory document", "", f"- project: {project}", f"- conflict: {kind}", f"- key: {key}", "", "Keep every fact that any version has, add none, keep contradictions visible, answer with the document alone.", ""]
    if deleted:
        lines += ["It was deleted on one side; weigh that before keeping it:", *(f"- `{d['filename']}` ({(d['base_hash'] or '-')[:8]})" for d in deleted), ""]
    for n, v in enumerate(versions, 1):
        marks = fence(v["text"] or "")
        lines += [f"## Version {n}: {v['label']} (`{v['filename']}`, {(v['content_hash'] or 'damaged')[:8]})", *([f"{marks}md", v["text"], marks] if v["text"] is not None else ["(not readable)"]), ""]
    return "\n".join(lines).rstrip("\n") + "\n"


def prompts(conflicts: DataFrame) -> DataFrame:
    """project_key, key, prompt for conflicts(project_key, key, kind, label, filename, content_hash, text, deleted), a row for each version."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["filename", "label"]).astype(object).where(frame.notna(), None).to_dict("records")
        text = prompt(rows[0]["project_key"], rows[0]["kind"], rows[0]["key"], [r for r in rows if not r["deleted"]], [{"filename": r["filename"], "base_hash": r["content_hash"]} for r in rows if r["deleted"]])
        return pd.DataFrame({"project_key": [rows[0]["project_key"]], "key": [rows[0]["key"]], "prompt": [text]})

    return conflicts.groupBy("project_key", "key").applyInPandas(build, "project_key string, key string, prompt string")
