"""A data source of configuration files: their lists as rows, parsed in tasks.

    lists.register(spark)
    spark.read.format("scenario_lists").option("names", "topic,tense").load("folder")

gives (file, name, place, value): a row for each item of each list of each YAML or JSON file of a folder,
and one with place 0 for each single value.  Names of nested mappings are joined by dots.  A file is a
partition.  The options ``files`` and ``names`` read only files and lists of these names, separated by commas.

They are options and no pushed filters: with pushed filters in Spark 4.1, a union of one loaded table under different
filters gave wrong rows, as if the filters of one use were applied to the others as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.storage import place_of

SUFFIXES = (".yaml", ".yml", ".json")


def parsed(name: str, content: str) -> dict:
    """A configuration file's mapping; a file that holds none fails by its name."""
    if name.endswith(".json"):
        value = json.loads(content)
    else:
        import yaml

        value = yaml.safe_load(content)
    if not isinstance(value, dict):
        raise ValueError(f"{name} holds no mapping of names to lists")
    return value


def entries(mapping: dict, above: str = "") -> Iterator[tuple[str, int, str | None]]:
    """(name, place, value) of each item of a mapping's lists, in order."""
    for name, value in mapping.items():
        if isinstance(value, dict):
            yield from entries(value, f"{above}{name}.")
        else:
            for k, item in enumerate(value if isinstance(value, list) else [value]):
                yield f"{above}{name}", k, item if isinstance(item, str) or item is None else json.dumps(item, ensure_ascii=False)


class File(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


class ListsReader(DataSourceReader):
    def __init__(self, path: str, files: set[str] | None, names: set[str] | None) -> None:
        self.path, self.files, self.names = path, files, names

    def partitions(self) -> list[InputPartition]:
        store, place = place_of(self.path)
        found = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(place)) if i.base_name.endswith(SUFFIXES))
        return [File(name) for name in found if self.files is None or name in self.files]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # of no files
            return
        store, folder = place_of(self.path)
        with store.open_input_file(f"{folder}/{partition.value}") as file:
            content = file.read().decode()
        for name, place, value in entries(parsed(partition.value, content)):
            if self.names is None or name in self.names:
                yield (partition.value, name, place, value)


class ScenarioLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scenario_lists"

    def schema(self) -> str:
        return "file string, name string, place int, value string"

    def reader(self, schema: object) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("scenario_lists needs the path of a folder")
        wanted = lambda option: {x.strip() for x in self.options[option].split(",")} if self.options.get(option) else None
        return ListsReader(self.options["path"], wanted("files"), wanted("names"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ScenarioLists)
