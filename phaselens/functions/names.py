"""Names of files and of point-spread functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a point-spread function's name, in order: label, column, unit (fixed values).
PARTS = [("M", "m", 1.0), ("NA", "na", 1.0), ("MLPitch", "ml_pitch", 1e-6), ("fml", "fml", 1e-6), ("from", "zmin", 1e-6), ("to", "zmax", 1e-6), ("zspacing", "zspacing", 1e-6), ("Nnum", "nnum", 1.0), ("lambda", "lam", 1e-9), ("n", "n", 1.0)]
#: Prefixes and whether each is normalised by flux (fixed values).
PREFIXES = {"fdnormpsfmatrix_": True, "reducedpsfmatrix_": False, "reducedbuggypsfmatrix_": False}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Without the last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def deconvolved_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_deconvolved.tif"))


def rectified_name(path: Column, n: int) -> Column:
    return F.concat(stem(path), F.lit(f"_N{n}"), extension(path))


def plane_name(plane: Column, transposed: bool = False) -> Column:
    return F.format_string("Ht%02d.array" if transposed else "H%02d.array", plane)


def short_number(value: Column) -> Column:
    """Up to 6 significant digits without trailing zeros, for values from 0.0001 to a million."""
    digits = F.when(value == 0, F.lit(0)).otherwise(5 - F.floor(F.log10(F.abs(value)))).cast("int")
    shown = F.format_string("%.10f", F.round(value * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits))
    return F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def psf_name(optics: DataFrame, prefix: str = "fdnormPSFmatrix_") -> Column:
    """The name that says a point-spread function's parameters, which are columns in SI units."""
    parts = [x for label, column, unit in PARTS for x in (F.lit(label), short_number(F.col(column) / unit))]
    return F.concat(F.lit(prefix), *parts, F.lit(".mat"))


def parse_psf_names(names: DataFrame, path: str = "path") -> DataFrame:
    """path, normalised, buggy and the ten parameters in SI units; the prefix may have any case.

    Names that aren't of this form have null parameters; ``require_generated`` refuses them.
    """
    name = base_name(F.col(path))
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    pattern = r"^(?i:fdnormPSFmatrix_|reducedPSFmatrix_|reducedBuggyPSFmatrix_)" + "".join(label + number for label, _, _ in PARTS) + r"\.mat$"
    values = [
        (F.regexp_extract(name, pattern, k + 1).try_cast("double") * F.lit(unit)).alias(column) if column != "nnum" else F.regexp_extract(name, pattern, k + 1).try_cast("int").alias(column)
        for k, (_, column, unit) in enumerate(PARTS)
    ]
    prefix = F.lower(F.regexp_extract(name, "^([A-Za-z]+_)", 1))
    return names.select(path, (prefix == "fdnormpsfmatrix_").alias("normalised"), (prefix == "reducedbuggypsfmatrix_").alias("buggy"), *values)


def require_generated(parsed: DataFrame) -> DataFrame:
    """An error for the first name that can't be generated from."""
    return parsed.withColumn("m", F.when(F.col("m").isNull(), F.raise_error(F.concat(F.lit("not the name of a point-spread function to generate: "), F.col(parsed.columns[0])))).otherwise(F.col("m")))


def is_numbered(word: Column, letter: str) -> Column:
    """Command words such as x30: a letter and digits."""
    return word.rlike(f"^{letter}[0-9]+$")


def without_comment(line: Column) -> Column:
    return F.trim(F.substring_index(line, "#", 1))
