"""Pages from HTML to rows, with repeated segments dropped across all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import extract_pages, render_documents
from ..kernel.options import Options
from .blocks import without_repeated_segments
from .lineage import cut

METADATA = ("title", "author", "url", "hostname", "description", "sitename", "date", "categories", "tags", "id", "license", "language", "image", "pagetype", "filedate")


def extract_deduplicated(pages: DataFrame, options: Options | None = None, *, key: str = "url", **named) -> DataFrame:
    """(key, status, text, output, text_len, repeats): extracted pages without the segments that came often enough before, in the order of ``key``.

    Each page is parsed once, and its record written; blocks are then compared across all pages, and what is left is rendered in the format of the
    options. A page that loses all its text has the status ``duplicate``. ``key`` must be unique. The extracted records, not the pages, are
    what the join on the key moves.
    """
    options = options or Options.of(**named)
    renamed = "__key"
    fields = ("status", "body", "commentsbody", "blocks", *(METADATA if options.with_metadata else ()))
    found = cut(extract_pages(pages.withColumn(renamed, F.col(key)), options, keep=(renamed,), fields=fields))
    blocks = found.where("status = 'ok'").select(renamed, F.explode("blocks").alias("b")).select(renamed, "b.*").where(~F.col("is_comment"))
    kept = without_repeated_segments(blocks, order_by=(renamed, "pos"), min_size=options.min_duplicate_size, max_repetitions=options.max_repetitions)
    dropped = blocks.select(renamed, "pos").join(kept.select(renamed, "pos"), [renamed, "pos"], "left_anti").groupBy(renamed).agg(F.sort_array(F.collect_list("pos")).alias("__drop"))
    joined = found.drop("blocks").join(dropped, renamed, "left").withColumn("repeats", F.coalesce(F.size("__drop"), F.lit(0)))
    joined = joined.withColumn("repeats", F.greatest("repeats", F.lit(0)))
    out = render_documents(joined, options, keep=(renamed, "status", "repeats"), drop_col="__drop")
    size = F.coalesce("text_len", F.lit(0))
    status = F.when((F.col("status") == "ok") & (F.col("repeats") > 0) & (size < F.greatest(F.lit(options.min_output_size), F.lit(1))), F.lit("duplicate")).otherwise(F.col("status"))
    return out.select(F.col(renamed).alias(key), status.alias("status"), "text", "output", size.alias("text_len"), "repeats")
