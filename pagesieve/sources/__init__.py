"""Where pages come from, and where results go."""

from .files import read_html_files, read_pages, read_url_list, write_documents, write_files, write_raw_pages
from .web import WebPages, fetch_pages, register

__all__ = ["WebPages", "fetch_pages", "read_html_files", "read_pages", "read_url_list", "register", "write_documents", "write_files", "write_raw_pages"]
