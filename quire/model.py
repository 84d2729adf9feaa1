"""Schemas of the engine's tables."""

from __future__ import annotations

#: A property: its value as JSON text, and what a filter compares (a list's elements, or the value itself).
PROPERTIES = "array<struct<name: string, ord: int, type: string, json: string, items: array<struct<kind: string, text: string>>>>"
SECTIONS = "array<struct<level: int, heading: string, line: int, end_line: int, links: array<string>, task_total: int, task_done: int, code_blocks: array<string>>>"
TASKS = "array<struct<line: int, section: string, status: string, text: string, done: boolean>>"
LINKS = "array<struct<line: int, kind: string, target: string, label: string, fragment: string>>"
LINES = "array<struct<line: int, kind: string, raw: string, cleaned: string, section: string>>"
META = f"rel_path string, modified timestamp, parse_error string, properties {PROPERTIES}, tags array<string>, title string, front_lines int"
NOTES = f"{META}, sections {SECTIONS}, tasks {TASKS}, links {LINKS}, lines {LINES}, text string"
