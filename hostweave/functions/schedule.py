"""Crontab fields as sets of allowed numbers."""

from pyspark.sql import Column, functions as F

# Field ranges, names and shorthands of crontab(5).
FIELD_RANGES = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 7)}
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAY_NAMES = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
SHORTHANDS = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}


def spelled_out(schedule: Column) -> Column:
    """Trimmed schedule with shorthands replaced by their five fields."""
    text = F.trim(schedule)
    table = F.create_map(*[F.lit(x) for pair in SHORTHANDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def is_unrestricted(field: Column) -> Column:
    return field.isin("*", "?")


def allowed_numbers(field: Column, kind: str) -> Column:
    """Sorted numbers a field allows; NULL when any of its items is malformed."""
    low, high = FIELD_RANGES[kind]
    text = F.upper(field)
    names = {"month": (MONTH_NAMES, 1), "dow": (DAY_NAMES, 0)}.get(kind)
    if names:
        for number, name in enumerate(names[0], start=names[1]):
            text = F.replace(text, F.lit(name), F.lit(str(number)))
    shape = r"\A(?:[*?]|(\d{1,2})(?:-(\d{1,2}))?)(?:/(\d{1,2}))?\z"

    def number(item: Column, group: int, default: Column) -> Column:
        found = F.nullif(F.regexp_extract(item, shape, group), F.lit(""))
        return F.coalesce(found.cast("int"), default)

    def item_numbers(item: Column) -> Column:
        starred = item.rlike(r"\A[*?]")
        stepped = item.contains("/")
        first = number(item, 1, F.lit(low))
        # "5/10" runs to the end of the range, "5" is one number, "*" is all of them.
        last = number(item, 2, F.when(starred | stepped, F.lit(6 if kind == "dow" else high)).otherwise(first))
        step = number(item, 3, F.lit(1))
        sound = item.rlike(shape) & (first >= low) & (last <= high) & (first <= last) & (step >= 1)
        return F.when(sound, F.sequence(first, last, F.greatest(step, F.lit(1))))

    parts = F.transform(F.split(text, ","), item_numbers)
    numbers = F.flatten(parts)  # NULL when one part is NULL
    if kind == "dow":
        numbers = F.transform(numbers, lambda n: n % 7)  # 7 is Sunday too
    return F.array_sort(F.array_distinct(numbers))
