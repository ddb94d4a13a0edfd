"""Command line: `python -m spanloom --store FOLDER {list,create,update,delete,map,prepare,query} …`."""

from __future__ import annotations

import argparse
import importlib
import json

from spanloom.functions import plugins
from spanloom.operators import cluster, cooccur, search
from spanloom.options import Options
from spanloom.plans import index, interrogate, preparation
from spanloom.session import get_session
from spanloom.sources import delimited
from spanloom.sources.corpora import CorpusStore


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="spanloom")
    parser.add_argument("--store", default="corpora", help="shared folder of the corpora")
    parser.add_argument("--config", help="JSON file with options")
    does = parser.add_subparsers(dest="does", required=True)
    does.add_parser("list")
    for name in ("update", "delete"):
        does.add_parser(name).add_argument("corpus")
    create, mapped = does.add_parser("create"), does.add_parser("map")
    create.add_argument("corpus")
    for one in (create, mapped):
        one.add_argument("--dataset", required=True)
        one.add_argument("--delimiter")
        one.add_argument("--column-mapping", type=json.loads)
    create.add_argument("--clustering-method", choices=sorted(cluster.METHODS), default=Options.clustering_method)
    create.add_argument("--encoder", default=Options.encoder)
    create.add_argument("--alpha-span-weight", type=float)
    create.add_argument("--split-files", action="store_true", help="the files have no line breaks within values")
    tagged = does.add_parser("prepare")
    tagged.add_argument("folder", help="text files")
    tagged.add_argument("target", help="where the mention table goes")
    tagged.add_argument("--tagger", required=True, help="module:name of a tagger class")
    ask = does.add_parser("query")
    ask.add_argument("corpus")
    ask.add_argument("terms", nargs="+")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--reranker")
    ask.add_argument("--ignore-case", action="store_true")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = _arguments(given)
    options = Options.from_json(args.config) if args.config else Options()
    spark = get_session("spanloom")
    store = CorpusStore(spark, args.store)
    if args.does == "list":
        store.status().show(1000, truncate=False)
    elif args.does == "update":
        index.update_corpus(spark, store, args.corpus, options)
    elif args.does == "delete":
        store.delete(args.corpus)
    elif args.does == "map":
        rows, used = delimited.map_dataset(spark, args.dataset, args.column_mapping, args.delimiter)
        print(json.dumps(used, indent=2), rows.count())
        delimited.preview(rows).show()
    elif args.does == "create":
        if args.alpha_span_weight is not None:
            options = Options(**{**options.__dict__, "alpha_span_weight": args.alpha_span_weight})
        index.create_corpus(
            spark, store, args.corpus, args.dataset, method=args.clustering_method, encoder=args.encoder,
            column_mapping=args.column_mapping, delimiter=args.delimiter, options=options, multi_line=not args.split_files,
        )
    elif args.does == "prepare":
        module, _, name = args.tagger.partition(":")
        preparation.prepare_folder(spark, args.folder, getattr(importlib.import_module(module), name)(), args.target)
    else:
        terms = spark.createDataFrame(list(enumerate(args.terms)), "query_id bigint, term string")
        reranker = plugins.reranker_named(args.reranker or options.reranker)
        hits = interrogate.query_corpus(
            store, args.corpus, terms, k=args.top_k, reranker=reranker, options=options
        ).cache()
        search.result_view(hits).drop("preview").orderBy("query_id", "rank").show(1000, truncate=False)
        found = cooccur.cooccurring_entities(store.load_index(args.corpus), hits, ignore_case=args.ignore_case)
        cooccur.ranked(found).show(1000, truncate=False)


if __name__ == "__main__":
    main()
