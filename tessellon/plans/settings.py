"""Options as a dataclass, and the command line's way to give them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

# The pattern of arguments, and the words for yes and no.
_ARGUMENT = re.compile(r"^--?(?:([a-zA-Z0-9]+)\.)?([a-zA-Z0-9_][a-zA-Z0-9-]*)(?:=(.*))?$")
_YES, _NO = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


def _option(group: str, default, *names: str):
    return field(default_factory=(lambda: list(default)) if isinstance(default, list) else (lambda: default), metadata={"group": group, "names": names})


@dataclass
class Settings:
    """All options; those about a terminal are read and have no effect here."""

    recursive: bool = _option("FileDiscovery", False, "Recursive", "R")
    processed_log_path: list[str] = _option("FileDiscovery", [], "ProcessedLogPath", "PLPath")
    skip_log_path: list[str] = _option("FileDiscovery", [], "SkipLogPath", "SLPath")
    done_log_path: str = _option("FileDiscovery", "", "DoneLogPath", "DLPath")
    with_extensions: str = _option("FileDiscovery", "", "WithExtensions", "WExts")
    concurrent: str = _option("FileDiscovery", "1", "Concurrent", "Conc")
    producer_min_read_length: int = _option("Processing", 1, "ProducerMinReadLength")
    producer_max_read_length: int = _option("Processing", 8, "ProducerMaxReadLength")
    print_available_simds: bool = _option("Processing", False, "PrintAvailableSIMDs")
    pause_before_exit: bool = _option("Processing", False, "PauseBeforeExit", "PBExit")
    buffer_length: int = _option("Processing", 64, "BufferLength", "BLength")
    consumers: list[str] = _option("Processing", [], "Consumers", "Cons")
    move_test: bool = _option("FileMove", False, "Test")
    move_log_path: str = _option("FileMove", "", "LogPath")
    move_mode: str = _option("FileMove", "None", "Mode")
    move_pattern: str = _option("FileMove", "${DirectoryName}/${FileName}", "Pattern")
    disable_file_move: bool = _option("FileMove", False, "DisableFileMove")
    disable_file_rename: bool = _option("FileMove", False, "DisableFileRename")
    replacements: str = _option("FileMove", "", "Replacements")
    print_hashes: bool = _option("Reporting", False, "PrintHashes")
    print_reports: bool = _option("Reporting", False, "PrintReports")
    reports: list[str] = _option("Reporting", [], "Reports")
    report_directory: str = _option("Reporting", "", "ReportDirectory", "RDir")
    report_file_name: str = _option("Reporting", "${FileName}.${ReportName}.${ReportFileExtension}", "ReportFileName")
    report_content_prefix: str = _option("Reporting", "", "ReportContentPrefix")
    extension_difference_path: str = _option("Reporting", "", "ExtensionDifferencePath", "EDPath")
    crc32_error: str = _option("Reporting", "", "CRC32Error")
    version: bool = _option("Diagnostics", False, "Version")
    save_errors: bool = _option("Diagnostics", False, "SaveErrors")
    skip_environment_element: bool = _option("Diagnostics", False, "SkipEnvironmentElement")
    include_personal_data: bool = _option("Diagnostics", False, "IncludePersonalData")
    print_discovered_files: bool = _option("Diagnostics", False, "PrintDiscoveredFiles")
    error_directory: str = _option("Diagnostics", ".", "ErrorDirectory")
    null_stream_test: str = _option("Diagnostics", "", "NullStreamTest")
    hide_buffers: bool = _option("Display", False, "HideBuffers")
    hide_file_progress: bool = _option("Display", False, "HideFileProgress")
    hide_total_progress: bool = _option("Display", False, "HideTotalProgress")
    show_display_jitter: bool = _option("Display", False, "ShowDisplayJitter")
    forward_console_cursor_only: bool = _option("Display", False, "ForwardConsoleCursorOnly")

    def partitions(self) -> tuple[int, list[tuple[str, int]]]:
        """`max:path,n;path,n` as (how many files at once, [(prefix, how many of it)])."""
        head, _, rest = self.concurrent.partition(":")
        pairs = [p.rsplit(",", 1) for p in rest.split(";") if p]
        return int(head), [(p, int(n)) for p, n in pairs]

    def replaced(self) -> list[tuple[str, str]]:
        return [tuple(p.split("=", 1)) for p in self.replacements.split(";") if "=" in p]

    def logs(self) -> tuple[list[str], list[str]]:
        """(logs to skip by, logs to write); the done log is in both, once, case aside."""

        def with_done(paths: list[str]) -> list[str]:
            out, seen = [], set()
            for p in [*paths, *([self.done_log_path] if self.done_log_path else [])]:
                if p.lower() not in seen:
                    seen.add(p.lower())
                    out.append(p)
            return out

        return with_done(self.skip_log_path), with_done(self.processed_log_path)


class Help(Exception):
    """Help was asked for."""


def _value(f, text: str | None):
    kind = type(f.default_factory())
    if kind is bool:
        if text is None or text.lower() in _YES:
            return True
        if text.lower() in _NO:
            return False
        raise ValueError(f"{f.metadata['names'][0]}: neither true nor false: {text}")
    if text is None:
        raise ValueError(f"{f.metadata['names'][0]} needs a value")
    if kind is list:
        return [x for x in text.split(",") if x]
    return int(text) if kind is int else text


def parse(argv: list[str]) -> tuple[Settings, list[str]]:
    """(settings, paths). One-letter names keep their case, a single dash takes several of them; other names don't.
    Arguments of digits and capitals only are dropped, as the tool that this follows does."""
    out, paths = Settings(), []
    every = [(f, n) for f in fields(Settings) for n in f.metadata["names"]]
    for arg in argv:
        if re.fullmatch(r"[0-9A-Z]+", arg):
            continue
        m = _ARGUMENT.match(arg)
        if not m:
            paths.append(arg)
            continue
        group, name, text = m.groups()
        if name.lower().startswith("help") or arg.startswith("-h"):
            raise Help
        short = not arg.startswith("--")
        if short and text is not None:
            raise ValueError(f"{arg}: switches take no value")
        for one in name if short else [name]:
            same = [f for f, n in every if (n == one if len(one) == 1 else n.lower() == one.lower()) and (not group or f.metadata["group"].lower() == group.lower())]
            if len(same) != 1:
                raise ValueError(f"{one}: {'ambiguous' if same else 'unknown'}")
            setattr(out, same[0].name, _value(same[0], text))
    return out, paths
