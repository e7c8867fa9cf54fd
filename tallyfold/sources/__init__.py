"""Sources: delimited text, tagged lines, quoted records, whole files and pieces of files."""

from .aside import read_setting_aside
from .delimited import read_delimited, read_pairs
from .files import read_lines, read_whole_files
from .pieces import read_file_pieces
from .records import read_quoted_records

__all__ = [
    "read_delimited",
    "read_file_pieces",
    "read_lines",
    "read_pairs",
    "read_quoted_records",
    "read_setting_aside",
    "read_whole_files",
]
