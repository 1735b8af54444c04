"""tidemark: text-assurance and corpus analytics expressed as Spark DataFrame plans."""
