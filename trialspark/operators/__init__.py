"""DataFrame operators: segmentation, interval joins, rates, statistics, tuning, receptive fields, encoding models, signals."""
