"""Statement analytics and corpus preparation on Spark."""

from tallyframe.operators.batch import certify_all, certify_batches
from tallyframe.operators.documents import certify_documents
from tallyframe.operators.extract import table_rows
from tallyframe.operators.pages import low_text
from tallyframe.operators.planner import PeriodError, cover, plan
from tallyframe.operators.run import Reports, extract_reports, write_reports
from tallyframe.operators.select import select_pages
from tallyframe.sources.demo import demo_facts
from tallyframe.sources.readers import aliases, document_files, page_texts
from tallyframe.sources.sinks import write_long, write_series, write_workbook
from tallyframe.sources.words import WordSource, word_source
from tallyframe.sources.workbooks import document_sheets, write_workbooks

__all__ = ["PeriodError", "Reports", "WordSource", "aliases", "certify_all", "certify_batches", "certify_documents", "cover", "demo_facts", "document_files", "document_sheets", "extract_reports", "low_text", "page_texts", "plan", "select_pages", "table_rows", "word_source", "write_long", "write_reports", "write_series", "write_workbook", "write_workbooks"]
