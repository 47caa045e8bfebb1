"""Fixed values shared by several queries: edges and labels of the age and stay bands."""

AGE_EDGES, AGE_LABELS = [0, 50, 65, 75, 85, 100], ["<50", "50-64", "65-74", "75-84", "85+"]
LOS_EDGES = [0, 3, 7, 14, 30, 1000]
LOS_LABELS = ["Short", "Medium", "Long", "Extended", "Very_Long"]
