"""Result lists as single files in one archive, with the SHA-256 of each."""

import hashlib
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from kinlode.sources import tsv

#: Folder of result lists and the column that holds the ids.
LISTS = {"candidate_pairs": "candidate_entity_ids", "matching_results": "matched_entity_ids"}


def check_results(spark: SparkSession, output_dir: str) -> int:
    """Rows of each list. Fails on repeated ids, ids of a wrong kind, or lists of other lengths or S1 ids."""
    found = {}
    for name, column in LISTS.items():
        lists = spark.read.csv(f"{output_dir}/{name}", sep="\t", header=True, quote="", schema=f"source1_entity_id string, {column} string", enforceSchema=False)
        bad = {r["problem"]: r["n"] for r in tsv.check_lists(lists, column).collect() if r["n"]}
        if bad:
            raise ValueError(f"{name}: {bad}")
        found[name] = lists.select("source1_entity_id")
    a, b = found.values()
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the lists have different S1 ids")
    return a.count()


def pack_results(spark: SparkSession, output_dir: str, archive: str) -> dict[str, str]:
    """Check the lists, join the part files of each under one header, and zip them beside MANIFEST.sha256. Files pass
    through in blocks, so the driver's memory does not grow with them. Returns name -> SHA-256."""
    check_results(spark, output_dir)
    sums = {}
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for name in LISTS:
            digest = hashlib.sha256()
            with out.open(f"{name}.tsv", "w", force_zip64=True) as file:
                for i, part in enumerate(sorted(Path(output_dir, name).glob("part-*"))):
                    with open(part, "rb") as rows:
                        if i:
                            rows.readline()  # each part has the header
                        while block := rows.read(1 << 20):
                            digest.update(block)
                            file.write(block)
            sums[f"{name}.tsv"] = digest.hexdigest()
        out.writestr("MANIFEST.sha256", "".join(f"{v}  {k}\n" for k, v in sums.items()))
    return sums
