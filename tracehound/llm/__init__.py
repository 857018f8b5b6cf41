"""Training-data operators: de-duplication, joins, mixing, packing, search
and tokenisation over corpora that are far larger than one machine."""
