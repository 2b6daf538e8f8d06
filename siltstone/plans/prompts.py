"""Prompt templates by kind of question, as data."""

from __future__ import annotations

TEMPLATES = {
    "existence": "Code:\n{context}\n\nQuestion: {query}\n\nDoes `{target}` exist, and what is it for?",
    "flow": "Code:\n{context}\n\nQuestion: {query}\n\nFollow the calls step by step and describe the order of execution.",
    "bug": "Code:\n{context}\n\nQuestion: {query}\n\nList defects and cases that are not handled.",
    "mvvm": "Code:\n{context}\n\nQuestion: {query}\n\nShow how view, view model and model are bound to each other.",
    "file_summary": "Code of `{target}`:\n{context}\n\nQuestion: {query}\n\nSay what this file does.",
    "error": "Error:\n{traceback}\n\nCode:\n{context}\n\nQuestion: {query}\n\nFind the cause of this {language} error and how to remove it.",
    "general": "Code:\n{context}\n\nQuestion: {query}\n\nAnswer, and quote the code that the answer rests on.",
}


ROUTER = (
    "Classify the question. Answer with JSON alone: type (bug, flow, search, mvvm or general), filenames (list), target_name (a function or "
    "class, or null), keywords (list), language (python, csharp, xaml or mixed)."
)


def prompt(kind: str, query: str, context: str, target: str | None = None, traceback: str | None = None, language: str = "python") -> str:
    """The template of a kind; unknown kinds are general."""
    return TEMPLATES.get(kind, TEMPLATES["general"]).format(query=query, context=context, target=target or "unknown", traceback=traceback or query, language=language)
