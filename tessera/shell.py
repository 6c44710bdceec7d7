"""The interactive shell: one command per line."""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from .functions.text import complete
from .operators.catalog import distinct_collections
from .operators.reads import CAP
from .sources.store import Busy, Rejected, Store, document_id

COMMANDS = ["insertOne", "insertMany", "findOne", "findMany", "updateOne", "deleteOne", "dumpAll", "dumpDB", "restoreDB", "compact", "exit", "quit"]


def json_arguments(rest: str) -> list[Any]:
    """JSON values one after another; spaces inside them don't matter."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(rest):
        if rest[at].isspace():
            at += 1
            continue
        value, at = decoder.raw_decode(rest, at)
        out.append(value)
    return out


def pretty(doc: str) -> str:
    try:
        return json.dumps(json.loads(doc), indent=2, ensure_ascii=False)
    except json.JSONDecodeError:
        return doc


class Shell:
    def __init__(self, store: Store):
        self.store = store

    def completions(self, line: str) -> list[str]:
        """A command, then a collection among the first keys."""
        if " " not in line:
            return complete(COMMANDS, line)
        keys = self.store.snapshot()
        names = distinct_collections(keys, keys["collection"], keys["_id"]).collect()
        return complete(sorted(r.collection for r in names), line.split(" ")[-1])

    def run(self, line: str) -> str | None:
        """The answer to a command; None ends the session."""
        word, _, rest = line.strip().partition(" ")
        word, rest = word.lower(), rest.strip()
        if word in ("exit", "quit"):
            return None
        if not word:
            return ""
        action = {c.lower(): getattr(self, c) for c in COMMANDS[:-2]}.get(word)
        if not action:
            return f"unknown command: {word}"
        try:
            return action(rest)
        except (Rejected, Busy, json.JSONDecodeError, ValueError) as e:
            return f"error: {e}"

    @staticmethod
    def _split(rest: str, n: int) -> tuple[str, list[Any]]:
        name, _, body = rest.partition(" ")
        values = json_arguments(body)
        if not name or len(values) != n:
            raise Rejected(f"a collection and {n} JSON values are needed")
        return name, values

    def insertOne(self, rest: str) -> str:  # noqa: N802
        name, (doc,) = self._split(rest, 1)
        return f"inserted {self.store.insert_one(name, json.dumps(doc, sort_keys=True, ensure_ascii=False))}"

    def insertMany(self, rest: str) -> str:  # noqa: N802
        name, (docs,) = self._split(rest, 1)
        if not isinstance(docs, list):
            raise Rejected("an array is needed")
        return "inserted {} of {}".format(*self.store.insert_many(name, docs, strict=False))

    def findOne(self, rest: str) -> str:  # noqa: N802
        name, (filter_,) = self._split(rest, 1)
        found = self.store.get(name, document_id(filter_))
        return "not found" if found is None else pretty(found)

    def findMany(self, rest: str) -> str:  # noqa: N802
        name, values = self._split(rest, 1) if " " in rest else (rest, [{}])
        rows = self.store.find(name, values[0], CAP + 1).collect()
        more = [f"... more than {CAP}"] * (len(rows) > CAP)
        return "\n".join([pretty(r.doc) for r in rows[:CAP]] + more + [f"{min(len(rows), CAP)} documents"])

    def updateOne(self, rest: str) -> str:  # noqa: N802
        name, (filter_, update) = self._split(rest, 2)
        return "updated" if self.store.update_one(name, document_id(filter_), update) else "not found"

    def deleteOne(self, rest: str) -> str:  # noqa: N802
        name, (filter_,) = self._split(rest, 1)
        self.store.delete(name, document_id(filter_))
        return "deleted"

    def dumpAll(self, rest: str) -> str:  # noqa: N802
        return "\n".join(pretty(r.doc) for r in self.store.find(rest, {}, CAP).collect())

    def dumpDB(self, rest: str) -> str:  # noqa: N802
        path = rest or f"{self.store.root}/{self.store.dump_name()}"
        self.store.dump(path)
        return f"dumped to {path}"

    def restoreDB(self, rest: str) -> str:  # noqa: N802
        return f"restored {self.store.restore(rest)} documents"

    def compact(self, rest: str) -> str:
        self.store.flush()  # which compacts what is due
        return "compacted" if self.store.compact(force=rest == "force") else "nothing to compact"


def bind_completion(shell: Shell) -> None:
    """The tab key completes, where there is a line editor."""
    try:
        import readline
    except ImportError:
        return

    def complete_word(word: str, nth: int) -> str | None:
        found = [w for w in shell.completions(readline.get_line_buffer()) if w.lower().startswith(word.lower())]
        return found[nth] if nth < len(found) else None

    readline.set_completer(complete_word)
    readline.set_completer_delims(" ")
    readline.parse_and_bind("tab: complete")


def main(root: str) -> None:
    shell = Shell(Store(SparkSession.builder.appName("tessera").getOrCreate(), root, background=True))
    bind_completion(shell)
    try:
        while True:
            try:
                answer = shell.run(input("> "))
            except EOFError:
                return
            if answer is None:
                return
            print(answer)
    finally:
        shell.store.close()


if __name__ == "__main__":
    main(sys.argv[1])
