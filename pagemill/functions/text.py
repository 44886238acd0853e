"""Names, paths and enumerations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_path(path: Column) -> Column:
    """Forward slashes, without '.' and empty parts; '..' takes the part before it, and one too many gives ''."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    items = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))

    def step(acc, x):
        up = x == ".."
        ok = acc["ok"] & (~up | (F.size(acc["a"]) > 0))
        shorter = F.slice(acc["a"], F.lit(1), F.greatest(F.size(acc["a"]) - 1, F.lit(0)))
        return F.struct(F.when(up, shorter).otherwise(F.concat(acc["a"], F.array(x))).alias("a"), ok.alias("ok"))

    done = F.aggregate(items, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["a"], "/")))
    root = F.when(p.startswith("/"), "/").otherwise("")
    return F.coalesce(F.concat(root, done), F.lit(""))


def natural_key(name: Column) -> Column:
    """Sort key: digit runs by value and before other characters, which are equal to each other; shorter first."""
    tokens = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9])"), F.lit(1))
    return F.transform(tokens, lambda t: F.coalesce(F.when(t.rlike("^[0-9]"), F.try_to_number(t, F.lit("9" * 18)).cast("long")), F.lit((1 << 63) - 1)))


def output_name(file_name: Column, label: Column, page: Column, sub_page: Column, right_to_left: bool = False) -> Column:
    """<base>[(label)][_page0001][_1L].tif; the digit is the place in reading order."""
    base = F.regexp_replace(file_name, "\\.[^.]*$", "")
    left, right = (2, 1) if right_to_left else (1, 2)
    side = F.when(sub_page == 1, f"_{left}L").when(sub_page == 2, f"_{right}R").otherwise("")
    return F.concat(base, F.when(label > 0, F.concat(F.lit("("), label.cast("string"), F.lit(")"))).otherwise(""), F.when(page > 0, F.concat(F.lit("_page"), F.lpad(page.cast("string"), 4, "0"))).otherwise(""), side, F.lit(".tif"))


#: Texts of the enumerations, the first being what unknown texts give.
COLOR_MODES = ("bw", "color", "mixed")
DESPECKLE_LEVELS = ("normal", "off", "cautious", "aggressive")
DEWARPING_MODES = ("off", "auto", "manual")


def parse_enum(text: Column, values: tuple[str, ...]) -> Column:
    return F.when(text.isin(*values), text).otherwise(F.lit(values[0]))


def rewrite_prefix(path: Column, is_dir: Column, prefix: str, replacement: str) -> Column:
    """Directories: the prefix itself or below it; files: the exact path."""
    exact = path == prefix
    below = path.startswith(prefix + "/")
    return F.when(exact, F.lit(replacement)).when(is_dir & below, F.concat(F.lit(replacement), F.substring(path, len(prefix) + 1, 1 << 20))).otherwise(path)
