"""kgloom: knowledge-graph matching, ranked-retrieval evaluation and corpus operators on PySpark."""
