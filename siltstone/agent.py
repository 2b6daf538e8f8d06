"""An answer loop over the engine's tools. The models are functions of the caller's, so the loop itself can be tested."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from siltstone.functions.text import THINKING, THOUGHT
from siltstone.operators import context
from siltstone.plans.prompts import prompt
from siltstone.session import CodeEngine, tool_line

MAX_STEPS, MAX_CHUNKS = 6, 14
#: Takes the messages and the tools' descriptions; gives calls (name, arguments), none if it is ready to answer.
Planner = Callable[[list[dict], list[dict]], list[tuple[str, dict]]]
#: Takes the last prompt; gives the answer in pieces.
Answerer = Callable[[str], Iterator[str]]
_CHUNK = ("qualified_name", "name", "type", "content", "filepath", "start_line", "language")


def shown(pieces: Iterator[str]) -> Iterator[str]:
    """An answer's pieces with its thinking tags shown as text, also tags that are cut between pieces: what may be the beginning
    of a tag waits for the next piece."""
    tags, held = {"<thinking>": THINKING, "</thinking>": THOUGHT}, ""
    for piece in pieces:
        held += piece
        for tag, text in tags.items():
            held = held.replace(tag, text)
        at = held.rfind("<")
        ready = held if at < 0 or not any(tag.startswith(held[at:]) for tag in tags) else held[:at]
        held = held[len(ready) :]
        if ready:
            yield ready
    if held:
        yield held


@dataclass
class Agent:
    engine: CodeEngine
    planner: Planner
    answerer: Answerer
    log: list[str] = field(default_factory=list)

    def _shown(self, name: str, arguments: dict) -> tuple[str, str, list[dict]]:
        """What a tool found, as text for the planner, as a line for the log, and as chunks."""
        found = self.engine.tools()[name]["function"](**arguments)
        if name == "query_knowledge_graph":
            lines, found = found
            shown = [r["line"] for r in lines.limit(1000).collect()]
            rows = self._rows(found)
            return "\n".join(shown) or "nothing", f"{len(shown)} relations", rows
        if name == "get_code_snippet":
            row = found.first()
            rows = self._rows(self.engine.chunks().where(F.col("qualified_name") == arguments["qualified_name"]))
            return (row["snippet"] if row else "not found"), (f"{len(rows[0]['content'])} characters" if rows else "not found"), rows
        rows = self._rows(found)
        return "\n".join(f"- {r['qualified_name']} ({r['filepath']}:{r['start_line']})" for r in rows) or "nothing", f"{len(rows)} matches", rows

    def _rows(self, found) -> list[dict]:
        order = ["position"] if "position" in found.columns else ["filepath", "start_line", "qualified_name"]
        return [r.asDict() for r in found.orderBy(*order).select(*_CHUNK).limit(1000).collect()]  # what one step shows

    def run(self, question: str) -> Iterator[str]:
        """The answer in pieces. At most MAX_STEPS steps, of each only the first call; an unknown tool ends the search. Chunks are
        kept by name, the last found wins; the first MAX_CHUNKS are the answer's context."""
        tools = self.engine.tools()
        specs = [{"name": n, "description": t["description"], "parameters": t["parameters"]} for n, t in tools.items()]
        messages, collected = [{"role": "user", "content": question}], {}
        self.log.clear()
        for _ in range(MAX_STEPS):
            calls = self.planner(messages, specs)
            if not calls or calls[0][0] not in tools:
                break
            name, arguments = calls[0]
            result, about, rows = self._shown(name, arguments)
            collected |= {r["qualified_name"]: r for r in rows}
            self.log.append(tool_line(name, arguments, about))
            messages += [{"role": "assistant", "tool": name, "arguments": arguments}, {"role": "tool", "content": result}]
        kept = list(collected.values())[:MAX_CHUNKS]
        body = ""
        if kept:
            rows = self.engine.spark.createDataFrame([(1, i + 1, *[r[c] for c in _CHUNK]) for i, r in enumerate(kept)], "one int, i int, qualified_name string, name string, type string, content string, filepath string, start_line int, language string")
            body = context.joined(rows, ["one"], ["i"], context.xml_item(F.col("i")), "", "xml").first()["xml"]
        yield from shown(self.answerer(prompt("general", question, f"<context>\n{body}</context>")))
