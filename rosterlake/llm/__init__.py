"""Training-data operators: packing, binary token output, sharding, chat
formatting, nearest neighbours, BPE, exact and near dedup, page extraction and
quality scoring.  Nothing outside this subpackage imports it."""
