"""Languages that can be indexed: a registry of descriptors, to which others can be added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from graphloom.functions import text
from graphloom.sources import zig


@dataclass(frozen=True)
class LanguageSupport:
    """What a language brings along; its functions are shipped to the executors with the query that uses them.

    parse: (text, path) -> an object with nodes, events and std_chains().  extract_imports: content column -> array of
    the paths it imports, by which files are ordered.  resolve_import_path: (importer, path[, limit]) columns -> path.
    parse_build_config: text of a build file -> names of dependencies.  external_symbols: (nodes, parsed, order, first
    id) -> (nodes, edges) of names from outside, or None for none of its own; see plans.index.external_symbols.
    """

    name: str
    extensions: tuple[str, ...]
    excluded_dirs: tuple[str, ...] = ()
    build_files: tuple[str, ...] = ()
    parse: Callable = field(default=lambda source, path: zig.Parser(source, path).parse())
    extract_imports: Callable = text.import_paths
    resolve_import_path: Callable = text.resolve_import
    parse_build_config: Callable = zig.dependencies
    external_symbols: Callable | None = None


def _standard_library(nodes, parsed, order, first_id):
    from graphloom.plans.index import external_symbols

    return external_symbols(nodes, parsed, order, first_id)


ZIG = LanguageSupport("zig", (".zig",), (".zig-cache", "zig-out"), ("build.zig", "build.zig.zon"), external_symbols=_standard_library)
LANGUAGES: dict[str, LanguageSupport] = {e: ZIG for e in ZIG.extensions}


def register(language: LanguageSupport) -> None:
    for e in language.extensions:
        LANGUAGES[e] = language


def unregister(language: LanguageSupport) -> None:
    for e in language.extensions:
        LANGUAGES.pop(e, None)


def by_extension(extension: str) -> LanguageSupport | None:
    return LANGUAGES.get(extension)


def by_name() -> dict[str, LanguageSupport]:
    return {x.name: x for x in LANGUAGES.values()}
