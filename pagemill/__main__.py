"""python -m pagemill [options] images... output: the stages over image files."""

from __future__ import annotations

import os
import sys
import tempfile

from pagemill.plans import cli

USAGE = """python -m pagemill [options] images... output
  images: files, folders, '-' for names from the standard input, or a project (.xml)
  --layout=0|1|1.5|2  --layout-direction=lr|rl  --orientation=left|right|upsidedown  --rotate=DEGREES  --deskew=auto|manual
  --content-box=LxT:WxH  --content-detection=normal|cautious|aggressive  --margins[-left|-top|-right|-bottom]=MM
  --alignment=original  --alignment-horizontal=left|center|right  --alignment-vertical=top|center|bottom  --dpi[-x|-y]=N  --output-dpi[-x|-y]=N
  --color-mode=black_and_white|color_grayscale|mixed  --white-margins  --normalize-illumination  --threshold=N  --despeckle=off|cautious|normal|aggressive
  --dewarping=off|auto  --depth-perception=N  --start-filter=1..6  --end-filter=1..6  --output-project=FILE  --work=FOLDER"""


def main(args: list[str]) -> int:
    work = next((a.split("=", 1)[1] for a in args if a.startswith("--work=")), None)
    try:
        o = cli.parse([a for a in args if not a.startswith("--work=")])
        if not o.output:
            raise cli.UsageError("no output folder")
    except ValueError as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 1
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from pagemill.plans import batch

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if work is None:
        work = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="pagemill-") if spark.sparkContext.master.startswith("local") else None)
    if work is None:
        print("give --work or set spark.checkpoint.dir to a folder that all machines share", file=sys.stderr)
        return 1
    found = batch.run(spark, o, work)
    n_bad = found["errors"].count()
    for r in found["errors"].limit(100).collect():  # the first hundred messages
        print(f"image {r.img}: {r.error}", file=sys.stderr)
    print(f"{found['pages'].count()} pages, {found['files'].count() if 'files' in found else 0} files, {n_bad} images that can't be taken")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
