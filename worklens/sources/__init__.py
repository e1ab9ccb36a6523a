from worklens.sources.files import scan_csv, scan_parquet, write_csv, write_parquet, write_text  # noqa: F401
from worklens.sources.work_items import WORK_ITEMS_SQL, work_items  # noqa: F401
