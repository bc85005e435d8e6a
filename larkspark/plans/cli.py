"""A line protocol for plans: prepares and executes JSON plans from files, and says where results are."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..sources import sinks
from ..sources.catalog import Catalog
from .planjson import plan

#: The commands.
PREPARE, EXECUTE_FILE, EXECUTE = "prepare plan from file ", "execute plan from file ", "execute plan from statement "


class Protocol:
    """Answers command lines until quit. Results go to folder, one for each execution."""

    def __init__(self, catalog: Catalog, folder: str, out: TextIO = sys.stdout):
        self.catalog, self.folder, self.out = catalog, folder.rstrip("/"), out
        self.spark: SparkSession = catalog.spark
        self.prepared: dict[str, DataFrame] = {}
        self.echo, self.results = False, 0

    def say(self, line: str) -> None:
        print(line, file=self.out, flush=True)

    def read(self, path: str) -> DataFrame:
        return plan(self.spark.read.text(path, wholetext=True).first()[0], self.catalog)

    def finish(self, df: DataFrame) -> None:
        path = f"{self.folder}/result{self.results}"
        self.results += 1
        sinks.write(df, path, "json")
        if self.echo:
            for row in self.spark.read.text(path).toLocalIterator():
                self.say(row[0])
        self.say(f"result in file {path}")

    def answer(self, line: str) -> bool:
        """Runs one command; false after quit."""
        command = line.strip()
        if command == "quit":
            self.say("quiting...")
            return False
        try:
            if command.startswith(PREPARE):
                label = f"stmt{len(self.prepared)}"
                self.prepared[label] = self.read(command[len(PREPARE) :])
                self.say(f"prepared statement with label {label}")
            elif command.startswith(EXECUTE_FILE):
                self.finish(self.read(command[len(EXECUTE_FILE) :]))
            elif command.startswith(EXECUTE):
                self.finish(self.prepared[command[len(EXECUTE) :]])
            elif command in ("echo results on", "echo results off"):
                self.echo = command.endswith("on")
                self.say("done")
            elif command.startswith("codegen "):  # generated code is the engine's
                self.say("done")
            elif command == "unloadall":
                self.prepared.clear()
                self.spark.catalog.clearCache()
                self.say("done")
            elif command:
                self.say("error (command not supported)")
        except Exception as e:  # the protocol goes on after a plan that fails
            self.say(f"error ({str(e).splitlines()[0] if str(e) else type(e).__name__})")
        return True


def serve(catalog: Catalog, folder: str, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    protocol = Protocol(catalog, folder, out)
    protocol.say("ready")
    for line in lines:
        if not protocol.answer(line):
            break
