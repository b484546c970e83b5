"""The reference has no streams. Points to blocks and groups to folds are projections and equi-joins, so they hold on a stream as they are."""
