"""Which files a run trains and validates on."""

import os
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tallyloom.sources.files import is_absolute, list_files, matches_something

#: Options naming training files, first set one wins. All but the last take
#: several entries and, without a validation option, split validation off.
TRAIN_OPTIONS = ("TRAIN_FILES", "DATASET_FILES", "DATASET_GLOB", "TRAIN_FILE")
VALID_OPTIONS = ("VALID_FILES", "VALID_FILE")
SINGLE = ("TRAIN_FILE", "VALID_FILE")


@dataclass(frozen=True)
class Sources:
    train: list[str]
    train_mode: str
    validation: list[str]
    validation_mode: str


#: An entry: what lies between commas and line ends, without the white space around it.
ENTRY = re.compile(r"[^,\s](?:[^,\n]*[^,\s])?")


def split_entries(text: str) -> list[str]:
    return ENTRY.findall(text)


def expand(spark: SparkSession, entries: list[str], base_dir: str) -> list[str]:
    """Files of all entries, each once; an entry is looked up in the working folder, then in ``base_dir``."""
    files: dict[str, None] = {}
    for entry in entries:
        entry = os.path.expanduser(entry)
        places = [entry] if is_absolute(entry) else [f"{d.rstrip('/')}/{entry}" for d in (os.getcwd(), base_dir)]
        hit = next((p for p in places if matches_something(spark, p)), None)
        if hit is None:
            raise FileNotFoundError(f"nothing matches {entry!r} in {places}")
        files.update(dict.fromkeys(list_files(spark, hit)))
    return list(files)


def resolve_sources(
    spark: SparkSession, options: dict[str, str], base_dir: str, default_train: str, default_validation: str
) -> Sources:
    """Training and validation files from options (empty values count as unset)."""
    if options.get("DATASET_DIR"):
        base_dir = os.path.expanduser(options["DATASET_DIR"])
        if not is_absolute(base_dir):
            base_dir = os.path.join(os.getcwd(), base_dir)

    def chosen(names, default):
        name = next((n for n in names if options.get(n)), None)
        if name is None:
            return "default", [default]
        return name, [options[name]] if name in SINGLE else split_entries(options[name])

    train_mode, train = chosen(TRAIN_OPTIONS, default_train)
    mode, validation = chosen(VALID_OPTIONS, default_validation)
    if mode == "default" and train_mode in TRAIN_OPTIONS[:3]:
        mode, validation = "auto_split", []
    return Sources(expand(spark, train, base_dir), train_mode, expand(spark, validation, base_dir), mode)
