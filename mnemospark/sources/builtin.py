"""The read-only catalogue of built-in capability cards: how to use this engine, and common host tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_id
from ..schema import SCHEMAS

# name, type, summary, trigger, resources
_CARDS = (
    ("memory-guide", "composite", "How the layers of the memory fit together and which operation reads or writes which.", "At the start of work with the memory.", ("search", "update", "dream")),
    ("memory-search", "mcp", "Finds the scene of a message and stores the message there.", "A user message arrives.", ("search",)),
    ("memory-update", "mcp", "Adds the agent's reply to a topic.", "A reply was given.", ("update",)),
    ("memory-consolidate", "mcp", "Groups topics, fades what is unused and renews the profile.", "A scene has many topics, or nothing happens for a while.", ("dream",)),
    ("memory-trajectory", "mcp", "Keeps the events of a session in order.", "A tool was called or gave a result.", ("trajectory_append", )),
    ("memory-crystallize", "mcp", "Turns a session's events into draft capabilities.", "A session went well and may be repeated.", ("crystallize",)),
    ("memory-capability-import", "mcp", "Imports a capability card from a file.", "A new tool or skill is to be known.", ("capability_import",)),
    ("host-read-file", "skill", "Reads a file of the host.", "The content of a file is needed.", ("read_file",)),
    ("host-write-file", "skill", "Writes a new file.", "A file is to be made.", ("write_file",)),
    ("host-edit-file", "skill", "Changes part of a file.", "A file is to be changed in places.", ("edit_file",)),
    ("host-search-files", "skill", "Searches names and contents of files.", "The place of something is not known.", ("search_files",)),
    ("host-run-command", "skill", "Runs a command of the shell.", "Something is to be built, tested or inspected.", ("run_command",)),
    ("host-web-search", "skill", "Searches the web.", "Knowledge from outside is needed.", ("web_search",)),
)


def builtin_capabilities(spark: SparkSession) -> DataFrame:
    """The cards as active capability records of origin builtin; they are never stored."""
    rows = [
        (name, kind, summary, trigger, [("mcp" if kind == "composite" else kind, r, r, summary, {}) for r in resources])
        for name, kind, summary, trigger, resources in _CARDS
    ]
    given = "name string, type string, summary string, trigger string, resources array<struct<type:string,name:string,ref:string,description:string,config:map<string,string>>>"
    cards = spark.createDataFrame(rows, given).withColumns({
        "id": hash_id("capability:", F.lower(F.trim("name"))), "version": F.lit("1"), "status": F.lit(1), "origin": F.lit("builtin"),
        "success_rate": F.lit(0.0), "trigger_count": F.lit(0), "created_at": F.lit(0), "updated_at": F.lit(0),
    })
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(SCHEMAS["capability"]).fields
    have = set(cards.columns)
    return cards.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
