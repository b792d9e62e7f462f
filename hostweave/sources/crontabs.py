"""Crontab files: jobs with their users and variables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Line grammar of crontab(5). A system table names the user before the command.
TIME = r"(@[A-Za-z]+|\S+[ \t]+\S+[ \t]+\S+[ \t]+\S+[ \t]+\S+)"
SYSTEM_LINE = rf"\A[ \t]*{TIME}[ \t]+(\S+)[ \t]+(\S.*)\z"
USER_LINE = rf"\A[ \t]*{TIME}[ \t]+()(\S.*)\z"
VARIABLE = r"\A[ \t]*([A-Za-z_][A-Za-z0-9_]*|\"[^\"]*\"|'[^']*')[ \t]*=[ \t]*(.*?)[ \t]*\z"
NOT_A_LINE = r"\A[ \t]*(#.*)?\z"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"\A(?:\"(.*)\"|'(.*)')\z", "$1$2")


def parse_crontabs(lines: DataFrame) -> DataFrame:
    """Jobs of crontab lines (node_name, path, source, owner, pos, line), in order of ``pos`` in a file.

    ``source`` system has the user in the line, user has it in ``owner``, the file's name. Gives
    node_name, path, pos, source, user, schedule (fields by one space, or an @ name), command, input
    and variables: those set on lines above, last ones first in force. The command ends at the first
    ``%`` without a backslash, what follows is its input, with line feeds for further ones. Blank lines,
    comments and lines of another shape are dropped; a null line is blank.
    """
    file = ["node_name", "path"]
    above = Window.partitionBy(*file).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace(F.coalesce("line", F.lit("")), r"[\r\n]+\z", "")
    read = lines.withColumn("_text", text).filter(~F.col("_text").rlike(NOT_A_LINE))
    is_set = F.col("_text").rlike(VARIABLE)
    pair = F.struct(_unquoted(F.regexp_extract("_text", VARIABLE, 1)).alias("k"), _unquoted(F.regexp_extract("_text", VARIABLE, 2)).alias("v"))
    held = F.collect_list(F.when(is_set, pair)).over(above)  # nulls are not collected; a file's variables are few
    shaped = read.withColumns({"_set": is_set, "_held": held}).filter("NOT _set")
    kind = F.when(F.col("source") == "system", SYSTEM_LINE).otherwise(USER_LINE)
    fields = [F.when(F.col("source") == "system", F.regexp_extract("_text", SYSTEM_LINE, i)).otherwise(F.regexp_extract("_text", USER_LINE, i)) for i in (1, 2, 3)]
    # Last assignments win: the list is read from its end, and a name that came is left out.
    names = F.transform("_held", lambda p: p["k"])
    last = F.filter("_held", lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
    parsed = shaped.filter(F.rlike("_text", kind)).select(
        *file, "pos", "source",
        F.when(F.col("source") == "system", fields[1]).otherwise(F.col("owner")).alias("user"),
        F.regexp_replace(fields[0], r"[ \t]+", " ").alias("schedule"),
        F.split(F.regexp_replace(fields[2], r"(?<!\\)%", "\n"), "\n", 2).alias("_parts"),
        F.map_from_entries(F.array_sort(last)).alias("variables"),
    )

    def plain(part: Column) -> Column:
        return F.replace(part, F.lit("\\%"), F.lit("%"))

    return parsed.select(
        *file, "pos", "source", "user", "schedule", plain(F.rtrim(F.col("_parts")[0])).alias("command"),
        plain(F.get("_parts", F.lit(1))).alias("input"), "variables",
    )
