"""Analytics of information cascades as Spark jobs: from posts and reshares to trees, graphs, models of spreading, predictions and their evaluation."""
