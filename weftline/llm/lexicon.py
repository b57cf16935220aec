"""Word lists that several operators use."""

# fixed values: given names
GIVEN = """aiko niko vera rosalind ivo zelda hana ravi lachlan petra gideon maren katherine alexander jarrah caspian odette johannes samuel silas isabella dagny william wilhelmina juno
dorothea jürgen benjamin josephine orson ingrid frederick yara arlo ursula henrietta quentin geneviève kiri leonard tobias íñigo tamsin abigail birgit émile bao bronte zachary susannah nadia linnea eleanor
delia esme penelope yusuf gabriella hamish emrys anselm guadalupe fleur farid soraya elizabeth konstantin charlotte lawrence matthias magdalena philippa margaret rhea xiomara francisco celeste vito greta
edward richard michael christopher zoë nathaniel thomas dimitri noémie robert victoria anthony malik wanda theodore james john mary anna maria david peter paul daniel laura sarah emma lucas julia martin
andrea carlos juan josé luis carmen pedro pierre jean marie claire sophie hans klaus helga fritz giovanni marco lucia omar fatima ahmed wei yuki kenji olga ivan sergei anders lars astrid""".split()  # fmt: skip
# fixed values: words of trades in names of firms
TRADES = "agency agent archive artist association band bank board books brass broadcast broadcasting bureau catalogue catering centre center chamber choir choral circle club collective collection college committee company concert concerts consulting council dance digital distribution editions edition engineering entertainment events federation festival film films foundation fund gallery group guild hall hire holdings hospital house industries institute instrument insurance international label league library licensing limited management media mechanical museum music musical network office orchestra partners performing piano press print printing production productions publishers publishing radio recording records registry rehearsal rental repair repairs repertoire rights royalties sale sales school screen service services shop society songs songwriters sound stage store studio studios systems television theatre ticket ticketing tours trust union university video visual works writers".split()
