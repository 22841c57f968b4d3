"""What a parser says about one file, before identifiers are given."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Span:
    """Lines from 1, columns from 0 in bytes."""

    start_line: int
    end_line: int
    start_column: int
    end_column: int


@dataclass
class ParameterRecord:
    name: str
    annotation: str | None = None
    default: str | None = None


@dataclass
class CallRecord:
    callee: str
    start_line: int
    end_line: int


@dataclass
class SymbolRecord:
    kind: str
    name: str
    qualified_name: str
    span: Span
    parent: int | None  # index into FileRecord.symbols
    parameters: list[ParameterRecord] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    calls: list[CallRecord] = field(default_factory=list)


@dataclass
class ImportRecord:
    module: str
    names: list[str]
    alias: str | None
    start_line: int
    end_line: int


@dataclass
class FileRecord:
    symbols: list[SymbolRecord] = field(default_factory=list)
    imports: list[ImportRecord] = field(default_factory=list)
    has_syntax_errors: bool = False
